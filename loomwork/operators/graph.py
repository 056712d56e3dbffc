"""The knowledge graph as two DataFrames: people, files, sessions and topics, and typed edges."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions import ids, text
from loomwork.operators import topics
from loomwork.schemas import GRAPH_EDGES, GRAPH_MEMBERS, GRAPH_NODES, conform
from loomwork.session import materialize

# Fixed value: nodes of the default view.
MAX_NODES = 220


@dataclass(frozen=True)
class Graph:
    """Nodes, typed edges, and which artifacts each node stands for (node, artifact).

    Artifacts may be named by their keys; ``id_of`` then makes their ids, by which nodes rank and are shown.
    """

    nodes: DataFrame
    edges: DataFrame
    members: DataFrame
    id_of: Callable[[Column], Column] = ids.same


def scope_to_repo(artifacts: DataFrame, edges: DataFrame, repo: str) -> tuple[DataFrame, DataFrame]:
    """One project: its commits, files and sessions, the messages of those sessions, and the
    edges whose ends are kept or are people."""
    own = artifacts.filter(
        (F.col("repo") == repo) & F.col("kind").isin("commit", "file", "ai_session")
    )
    kept_sessions = own.filter("kind = 'ai_session'").select(F.col("id").alias("dst_id"))
    kept_messages = (
        edges.filter("relation = 'message_of_session'")
        .join(kept_sessions, "dst_id", "left_semi")
        .select(F.col("src_id").alias("id"))
    )
    said = artifacts.filter("kind = 'ai_message'").join(kept_messages, "id", "left_semi")
    kept = own.unionByName(said)
    keep_ids = kept.select("id").distinct()

    def ends_kept(df: DataFrame, end: str) -> DataFrame:
        """Edges whose end is a person or a kept artifact; one join, so that the edges are made once."""
        met = df.join(keep_ids.withColumnRenamed("id", "_kept"), F.col(end) == F.col("_kept"), "left")
        return met.filter(ids.is_person(F.col(end)) | F.col("_kept").isNotNull()).select(df.columns)

    return kept, ends_kept(ends_kept(edges, "src_id"), "dst_id")


def person_names(artifacts: DataFrame, name: Column | None = None) -> DataFrame:
    """person, name: of all spellings of a person the one seen first (ties: the smaller)."""
    actor = F.col("actor")
    spellings = (
        artifacts.filter(F.col("kind").isin("commit", "ai_session") & (actor != ""))
        .groupBy("actor")
        .agg(F.min("created_at").alias("at"))
        .withColumn("person", ids.known_person_id(actor))
        .withColumn("name", ids.person_display(actor) if name is None else name)
    )
    first = spellings.groupBy("person").agg(F.min(F.struct("at", "actor", "name")).alias("first"))
    return first.select("person", F.col("first.name").alias("name"))


def person_file(artifacts: DataFrame, edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """person -> file with the number of the person's commits that modified it; of ``known`` people and files if given."""
    changed = edges.filter("relation = 'modified'").select("src_id", "dst_id")
    authors = artifacts.filter("kind = 'commit' AND actor <> ''").select(
        F.col("id").alias("src_id"), ids.known_person_id(F.col("actor")).alias("person")
    )
    if known is not None:
        authors = _known(authors, known, "person")
        changed = _known(changed, known, "dst_id")
    return (
        changed.join(authors, "src_id")
        .groupBy(F.col("person").alias("source"), F.col("dst_id").alias("target"))
        .agg(F.count("*").cast("double").alias("weight"))
    )


def authored_targets(artifacts: DataFrame, edges: DataFrame) -> DataFrame:
    """person, id, kind of everything people authored that is a commit or a session."""
    targets = artifacts.filter(F.col("kind").isin("commit", "ai_session")).select("id", "kind")
    return (
        edges.filter("relation = 'authored'")
        .select(F.col("src_id").alias("person"), F.col("dst_id").alias("id"))
        .join(targets, "id")
    )


def ran(artifacts: DataFrame, edges: DataFrame) -> DataFrame:
    """person -> session."""
    return (
        authored_targets(artifacts, edges)
        .filter("kind = 'ai_session'")
        .groupBy(F.col("person").alias("source"), F.col("id").alias("target"))
        .agg(F.lit(1.0).alias("weight"))
    )


def memberships(artifacts: DataFrame, edges: DataFrame, m: topics.TopicMembers) -> DataFrame:
    """node, artifact: what people authored, files and sessions themselves, what mentions a topic."""
    authored = authored_targets(artifacts, edges).select(F.col("person").alias("node"), F.col("id").alias("artifact")).distinct()
    things = artifacts.filter(F.col("kind").isin("file", "ai_session")).select(F.col("id").alias("node"), F.col("id").alias("artifact"))
    about = topics.explode_mask(m.artifacts, m.terms).join(topics.connected_terms(m), "term", "left_semi")
    themes = about.select(F.concat(F.lit("topic:"), "term").alias("node"), F.col("id").alias("artifact"))
    return conform(authored.unionByName(things).unionByName(themes), GRAPH_MEMBERS)


def nodes(
    artifacts: DataFrame, edges: DataFrame, m: topics.TopicMembers, id_of: Callable[[Column], Column] = ids.same
) -> DataFrame:
    authored = authored_targets(artifacts, edges).groupBy("person", "id").agg(F.lit(1))
    people = (
        authored.groupBy("person").agg(F.count("*").alias("artifact_count"))
        .join(person_names(artifacts), "person", "left")
        .select(
            F.col("person").alias("id"),
            F.coalesce("name", "person").alias("label"),
            F.lit("person").alias("kind"),
            F.lit("").alias("modality"),
            "artifact_count",
        )
    )
    modality = F.when(
        F.col("kind") == "file", F.coalesce(F.get_json_object("extra", "$.modality"), F.lit(""))
    ).otherwise("")
    things = artifacts.filter(F.col("kind").isin("file", "ai_session")).select(
        "id",
        F.coalesce(text.blank_to_null(F.col("title")), id_of(F.col("id"))).alias("label"),
        "kind",
        modality.alias("modality"),
        F.lit(1).cast("long").alias("artifact_count"),
    )
    themes = (
        topics.explode_mask(m.artifacts, m.terms).groupBy("term").agg(F.count("*").alias("artifact_count"))
        .join(topics.connected_terms(m), "term", "left_semi")
        .select(
            F.concat(F.lit("topic:"), "term").alias("id"),
            F.col("term").alias("label"),
            F.lit("topic").alias("kind"),
            F.lit("").alias("modality"),
            "artifact_count",
        )
    )
    return conform(people.unionByName(things).unionByName(themes), GRAPH_NODES)


def about(m: topics.TopicMembers, known: DataFrame | None = None) -> DataFrame:
    """topic -> person, session, file; of the ``known`` ones if given, which are looked up with their masks."""
    masks = m.people.unionByName(m.sessions).unionByName(m.files)
    if known is not None:
        masks = masks.join(known.select(F.col("id").alias("node")), "node", "left_semi")
    return topics.explode_mask(masks, m.terms).select(
        F.concat(F.lit("topic:"), "term").alias("source"),
        F.col("node").alias("target"),
        F.lit(1.0).alias("weight"),
    )


def node_ids(artifacts: DataFrame, edges: DataFrame, m: topics.TopicMembers) -> DataFrame:
    """The ids of all nodes, without what the nodes show."""
    people = authored_targets(artifacts, edges).select(F.col("person").alias("id")).distinct()
    things = artifacts.filter(F.col("kind").isin("file", "ai_session")).select("id")
    themes = topics.connected_terms(m).select(F.concat(F.lit("topic:"), "term").alias("id"))
    return people.unionByName(things).unionByName(themes)


def _known(edges: DataFrame, known: DataFrame, *ends: str) -> DataFrame:
    for end in ends:
        edges = edges.join(known.select(F.col("id").alias(end)), end, "left_semi")
    return edges


def _known_ends(edges: DataFrame, known: DataFrame) -> DataFrame:
    return _known(edges, known, "source", "target")


def edge_parts(
    artifacts: DataFrame, edges: DataFrame, m: topics.TopicMembers, known: DataFrame | None = None
) -> list[DataFrame]:
    """Typed edges between known nodes, a frame per relation, no loops; silver edges are unique by key already.

    ``known``: the node ids where they are stored. Ends are looked up where the fewest rows name them: people
    with their commits, files with the commits that modified them, what topics are about with its mask. A topic that concerns anything is a node.
    """
    known = node_ids(artifacts, edges, m) if known is None else known
    weight = F.when(F.coalesce("weight", F.lit(0.0)) == 0, 1.0).otherwise(F.col("weight"))

    def stored(relation: str, shown: str) -> DataFrame:
        """Stored edges, which may name anything."""
        found = edges.filter((F.col("relation") == relation) & (F.col("src_id") != F.col("dst_id"))).select(
            F.col("src_id").alias("source"),
            F.col("dst_id").alias("target"),
            F.lit(shown).alias("relation"),
            weight.alias("weight"),
        )
        return _known_ends(found, known)

    def derived(df: DataFrame, relation: str) -> DataFrame:
        return df.filter("source <> target").select("source", "target", F.lit(relation).alias("relation"), "weight")

    return [
        derived(person_file(artifacts, edges, known), "modified"),
        stored("co_edited", "co_edited"),
        derived(_known_ends(ran(artifacts, edges), known), "ran"),
        stored("ai_touched_file", "ai_touched"),
        derived(about(m, known), "about"),
    ]


def full_edges(
    artifacts: DataFrame, edges: DataFrame, m: topics.TopicMembers, known: DataFrame | None = None
) -> DataFrame:
    """The edges of all relations."""
    first, *others = edge_parts(artifacts, edges, m, known)
    for part in others:
        first = first.unionByName(part)
    return with_edge_ids(first)


def _edge_id() -> Column:
    return F.concat("relation", F.lit(":"), "source", F.lit("->"), "target")


def with_edge_ids(edges: DataFrame) -> DataFrame:
    return conform(edges.withColumn("id", _edge_id()), GRAPH_EDGES)


def build(
    artifacts: DataFrame, edges: DataFrame, m: topics.TopicMembers | None = None, known: DataFrame | None = None,
    id_of: Callable[[Column], Column] = ids.same,
) -> Graph:
    """The graph. Topic members and node ids are written once, as every part reads them."""
    m = topics.stored(topics.members(artifacts, edges)) if m is None else m
    known = materialize(node_ids(artifacts, edges, m), "node-ids") if known is None else known
    return Graph(
        nodes(artifacts, edges, m, id_of), full_edges(artifacts, edges, m, known), memberships(artifacts, edges, m), id_of
    )


def shown_edges(edges: DataFrame, id_of: Callable[[Column], Column]) -> DataFrame:
    """The edges by ids. The ends of co_edited ones, which have no direction, are in the order of their ids."""
    ends = edges.withColumns({"source": id_of(F.col("source")), "target": id_of(F.col("target"))})
    turned = (F.col("relation") == "co_edited") & (F.col("source") > F.col("target"))
    ordered = ends.withColumns(
        {"source": F.when(turned, F.col("target")).otherwise(F.col("source")), "target": F.when(turned, F.col("source")).otherwise(F.col("target"))}
    )
    return with_edge_ids(ordered)


def shown(graph: Graph) -> Graph:
    """The graph by ids, for one whose artifacts are named by their keys."""
    members = graph.members.select(graph.id_of(F.col("node")).alias("node"), graph.id_of(F.col("artifact")).alias("artifact"))
    return Graph(graph.nodes.withColumn("id", graph.id_of(F.col("id"))), shown_edges(graph.edges, graph.id_of), members)


# --- views of a built graph ---


def induced(graph: Graph, kept: DataFrame) -> Graph:
    """The given nodes and the edges with both ends among them."""
    members = graph.members.join(kept.select(F.col("id").alias("node")), "node", "left_semi")
    return replace(graph, nodes=kept, edges=_known_ends(graph.edges, kept), members=members)


def focus(graph: Graph, node: str) -> Graph:
    """A node, its neighbours in either direction, and the edges among them."""
    ends = graph.edges.filter((F.col("source") == node) | (F.col("target") == node))
    near = (
        ends.select(F.explode(F.array("source", "target")).alias("id"))
        .unionByName(graph.nodes.filter(F.col("id") == node).select("id"))
        .distinct()
    )
    return induced(graph, graph.nodes.join(near, "id", "left_semi"))


def degrees(edges: DataFrame) -> DataFrame:
    return (
        edges.select(F.explode(F.array("source", "target")).alias("id"))
        .groupBy("id").agg(F.count("*").alias("degree"))
    )


def overview_nodes(graph: Graph) -> DataFrame:
    """People, topics and sessions, and the files some topic is about."""
    linked = (
        graph.edges.filter("relation = 'about'").select(F.col("target").alias("id")).distinct()
    )
    files = graph.nodes.filter("kind = 'file'").join(linked, "id", "left_semi")
    return graph.nodes.filter("kind <> 'file'").unionByName(files.select(graph.nodes.columns))


def top_nodes(graph: Graph, candidates: DataFrame, max_nodes: int = MAX_NODES) -> DataFrame:
    """The ``max_nodes`` candidates of highest degree; ties go to the smaller id."""
    ranked = candidates.join(degrees(graph.edges), "id", "left").withColumn(
        "degree", F.coalesce("degree", F.lit(0))
    )
    return ranked.orderBy(F.desc("degree"), graph.id_of(F.col("id"))).limit(max_nodes)


def view(
    graph: Graph,
    *,
    scoped: bool = False,
    focus_on: str | None = None,
    kinds: list[str] | None = None,
    max_nodes: int = MAX_NODES,
) -> Graph:
    """What the graph page shows: a focus, or the best-connected nodes, then a kind filter.

    The node bound cuts before the kind filter and does not apply to a focus. An unknown focus
    falls back to the overview.
    """
    if focus_on and graph.nodes.filter(F.col("id") == focus_on).limit(1).count():
        shown = focus(graph, focus_on).nodes
    else:
        candidates = graph.nodes if scoped else overview_nodes(graph)
        shown = top_nodes(graph, candidates, max_nodes).drop("degree")
    if kinds:
        shown = shown.filter(F.col("kind").isin(*kinds))
    return induced(graph, shown)


def node_artifacts(graph: Graph, artifacts: DataFrame, node: str, n: int | None = None) -> DataFrame:
    """The artifacts of a node, or the first ``n`` by id, resolved to rows."""
    listed = graph.members.filter(F.col("node") == node).select(F.col("artifact").alias("id"))
    if n is not None:
        listed = listed.orderBy("id").limit(n)
    return artifacts.join(listed, "id", "left_semi")
