"""The public surface: the routes of a graph service as methods that give DataFrames.

``GraphTables`` holds the tables; ``Explore`` is a trail of steps through the graph.
Arguments are read as a request's are: unreadable counts are the default,
counts are clamped, of repeated parameters the last counts, and what can't be
read is refused with a code.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import model
from tessera.functions import timeline
from tessera.operators import graph, reading, scene, sequence, xref

# Codes of refusals.
REFUSALS = ("bad_window", "bad_ref", "bad_kind", "bad_dir", "bad_scope", "bad_corpus", "not_found", "internal")


class Refused(ValueError):
    def __init__(self, code: str, detail: object = ""):
        if code not in REFUSALS:
            raise AssertionError(code)
        self.code = code
        super().__init__(f"{code}: {detail}")


def last_of(value: object) -> object:
    """Of repeated parameters the last."""
    return value[-1] if isinstance(value, (list, tuple)) and value else value


def count_of(value: object, default: int, most: int) -> int:
    value = last_of(value)
    if value is None:
        return default
    try:
        return max(1, min(int(str(value)), most))
    except ValueError:
        return default


def window_of(first: object, last: object) -> tuple[int, int]:
    try:
        return timeline.check_window(int(str(last_of(first))), int(str(last_of(last))))
    except ValueError as error:
        raise Refused("bad_window", f"{first}..{last}") from error


def kind_of(label: str) -> tuple[str, str]:
    """Relation and direction of an edge label."""
    for rel, (forward, inverse) in model.DIRECTED.items():
        if label in (forward, inverse):
            return rel, "forward" if label == forward else "inverse"
    for rel, both in model.SYMMETRIC.items():
        if label == both:
            return rel, "both"
    raise Refused("bad_kind", label)


@dataclass(frozen=True)
class Explore:
    """A trail through the graph: where one is, and how one got there."""

    index: DataFrame
    here: DataFrame  # start, position
    trail: tuple[str, ...] = ()

    def follow(self, label: str) -> Explore:
        """Along one kind of edge to all distinct ends."""
        rel, direction = kind_of(label)
        return replace(self, here=graph.step(self.here, self.index, rel, direction), trail=(*self.trail, label))

    def links(self) -> DataFrame:
        """Kinds of edges from here, with their labels and counts."""
        mine = self.index.join(self.here.select("position").distinct(), "position", "left_semi")
        kinds = F.broadcast(model.edge_kinds(self.index.sparkSession))
        return graph.edge_summary(mine).join(kinds, ["rel", "dir"])

    def back(self) -> Explore:
        """The trail without its last step, walked again from the start."""
        return self.replay(self.trail[:-1])

    def replay(self, trail: tuple[str, ...]) -> Explore:
        start = self.start()
        for label in trail:
            start = start.follow(label)
        return start

    def start(self) -> Explore:
        starts = self.here.select("start").distinct()
        return Explore(self.index, starts.select("start", F.col("start").alias("position")))

    def both(self, other: Explore) -> Explore:
        """All positions of two trails."""
        return replace(self, here=self.here.unionByName(other.here).distinct())


@dataclass(frozen=True)
class GraphTables:
    """Tables of one published graph.

    ``nodes``: id, kind, label; ``rows``: lowered rows; ``events``: event,
    narrative, place, from_year, to_year; ``spine``: chapter, verse, text, ord;
    ``citations``: from_unit, to_unit, votes, seen; all but nodes and rows may
    be absent.
    """

    spark: SparkSession
    nodes: DataFrame
    rows: DataFrame
    events: DataFrame | None = None
    spine: DataFrame | None = None
    citations: DataFrame | None = None
    polities: DataFrame | None = None
    eras: DataFrame | None = None

    @property
    def index(self) -> DataFrame:
        return graph.bi_index(self.rows)

    # node, elements, edges

    def node(self, node_id: str) -> DataFrame:
        """A node's card: its columns and its edges by kind; an unknown id is refused."""
        card = self.nodes.where(F.col("id") == node_id)
        if card.head() is None:
            raise Refused("not_found", node_id)
        summary = graph.edge_summary(self.index.where(F.col("position") == node_id)).drop("position")
        kinds = F.broadcast(model.edge_kinds(self.spark))
        named = summary.join(kinds, ["rel", "dir"]).agg(F.sort_array(F.collect_list(F.struct("kind_order", "label", "n_edges"))).alias("edges"))
        return card.crossJoin(named)  # one row each

    def elements(self, ids: list[str], cursor: object = None) -> DataFrame:
        first = count_of(cursor, 1, len(ids) + 1) - 1
        asked = list(enumerate(ids))[first : first + graph.MAX_ELEMENTS]
        places = self.spark.createDataFrame([(k - first, i) for k, i in asked], "place int, id string")
        return graph.elements(self.nodes, places).orderBy("place")

    def edges(self, position: str, label: str, cursor: tuple[int, int] | None = None, limit: object = None) -> DataFrame:
        rel, direction = kind_of(label)
        page = graph.edge_page_at(self.index, position, rel, direction, cursor, count_of(limit, graph.PAGE, graph.MAX_PAGE))
        return graph.edges_with_nodes(page, self.nodes).orderBy("place")

    def edge(self, edge_id: str) -> DataFrame:
        """The rows behind an edge, in row order."""
        found = self.rows.where(F.col("edge_id") == edge_id).orderBy("family", "row_ord")
        if found.head() is None:
            raise Refused("not_found", edge_id)
        return found

    def explore(self, *ids: str) -> Explore:
        return Explore(self.index, self.spark.createDataFrame([(i, i) for i in ids], "start string, position string"))

    def find(self, term: str) -> DataFrame:
        """Nodes whose label has the term, whatever its case; an empty term is refused."""
        if not term.strip():
            raise Refused("bad_ref", "empty term")
        return self.nodes.where(F.contains(F.lower("label"), F.lit(term.lower()))).orderBy("kind", "id")

    def kinds(self) -> DataFrame:
        """Counts of nodes by kind and of edges by relation."""
        nodes = self.nodes.groupBy(F.col("kind").alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("node"))
        edges = self.rows.groupBy(F.col("rel").alias("name")).agg(F.count_distinct("edge_id").alias("n")).withColumn("what", F.lit("edge"))
        return nodes.unionByName(edges)

    # reading

    def text(self, start: int, n: object = None, direction: str = "forward") -> DataFrame:
        if direction not in ("forward", "backward"):
            raise Refused("bad_dir", direction)
        return reading.window(self._has(self.spine, "bad_corpus"), start, count_of(n, reading.WINDOW, reading.MAX_WINDOW), direction == "backward").orderBy("ord")

    def chapter(self, chapter: object) -> DataFrame:
        return self._has(self.spine, "bad_corpus").where(F.col("chapter") == chapter).orderBy("ord").limit(reading.CHAPTER_PROBE)

    def contents(self, group) -> DataFrame:
        return reading.contents(self._has(self.spine, "bad_corpus"), group).orderBy("grp")

    def xrefs(self, k: int = xref.TOP) -> DataFrame:
        """Top targets of every unit at once."""
        previews = self.nodes.select(F.col("id").alias("to_unit"), F.col("label").alias("preview"))
        return xref.top_targets(self._has(self.citations, "not_found"), "from_unit", "to_unit", "seen", previews, k)

    # scenes

    def scene(self, first: object, last: object) -> dict[str, DataFrame]:
        a, b = window_of(first, last)
        events = self._has(self.events, "not_found")
        arrows = scene.arrows(events, a, b, ["from_year", "event"])
        return {"places": scene.lit(events, a, b), "quiet_places": scene.quiet(events, a, b), "arrows": arrows, "narratives": scene.legend(events, arrows, a, b)}

    def polities_in(self, first: object, last: object) -> DataFrame:
        return scene.in_window(self._has(self.polities, "not_found"), *window_of(first, last)).orderBy("polity", "from_year")

    def era_list(self) -> DataFrame:
        return self._has(self.eras, "not_found").orderBy("from_year", "to_year")

    def narrative_of(self, event: object) -> DataFrame:
        """The event's neighbours in its narratives."""
        return sequence.neighbours(self._has(self.events, "not_found"), ["narrative"], "event", ["from_year", "event"]).where(F.col("event") == event)

    def map_of_eras(self) -> DataFrame:
        """``era, place``: places that each era's window lights; eras are few and are joined by range."""
        eras = F.broadcast(self._has(self.eras, "not_found").select("era", F.col("from_year").alias("a"), F.col("to_year").alias("b")))
        events = self._has(self.events, "not_found")
        return events.join(eras, timeline.intersects(F.col("from_year"), F.col("to_year"), F.col("a"), F.col("b"))).select("era", "place").distinct()

    @staticmethod
    def _has(table: DataFrame | None, code: str) -> DataFrame:
        if table is None:
            raise Refused(code)
        return table
