"""The graph value that every operator takes and gives."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.session import written

NODE = "id string, entity_id string, space_id string, type_id string, valid_start long, valid_end long, readers array<string>"
EDGE = "id string, predicate string, src string, dst string, valid_start long, valid_end long, polarity string, context string, readers array<string>"
ATTACHMENT = "id string, host_kind string, host_id string, key string, value string, valid_start long, valid_end long, readers array<string>"
NODE_COLS, EDGE_COLS, ATTACHMENT_COLS = ([c.split()[0] for c in s.split(", ")] for s in (NODE, EDGE, ATTACHMENT))
POSITIVE, NEGATIVE = "positive", "negative"
ALL = "*"


@dataclass(frozen=True)
class Graph:
    """Nodes, edges and attachments as DataFrames, with what is known about their completeness.

    ``valid_start``/``valid_end`` are half-open; null end = open, a node with
    null start is always valid.  Extra columns come through untouched.
    """

    nodes: DataFrame
    edges: DataFrame
    attachments: DataFrame | None = None
    coverage: str = "complete"
    diagnostics: tuple[str, ...] = field(default=())
    #: The one context its claims were made in, after a selection; ALL before one.  Graphs of different ones don't mix.
    selection: str | None = ALL

    def with_(self, **changes) -> Graph:
        return replace(self, **changes)

    def ordered(self) -> Graph:
        """Members in canonical order, by id: for what leaves the engine."""
        att = self.attachments
        return self.with_(
            nodes=self.nodes.orderBy("id"), edges=self.edges.orderBy("id"),
            attachments=None if att is None else att.orderBy("id")
        )

    def settled(self, spark_name: str = "graph") -> Graph:
        """Written once: what is read several times, or put into loops, is not derived again."""
        att = self.attachments
        kept = {"nodes": written(self.nodes, spark_name), "edges": written(self.edges, spark_name)}
        return self.with_(**kept, attachments=None if att is None else written(att, spark_name))

    def pruned(self) -> Graph:
        """Without edges that lost an endpoint and attachments that lost their host.

        Inner joins with distinct ids instead of semi-joins: these would be pushed
        below the unions that graphs are made of and read every node table once
        for every edge table."""
        edges = having(having(self.edges, "src", self.nodes), "dst", self.nodes)
        return self.with_(edges=edges, attachments=hosted(self.attachments, self.nodes, edges))


def having(df: DataFrame, col: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``col`` is among ``ids`` (id), each once."""
    want = ids.select(F.col("id").alias("_has")).distinct()
    return df.join(want, F.col(col) == F.col("_has")).drop("_has")


def hosted(attachments: DataFrame | None, nodes: DataFrame, edges: DataFrame) -> DataFrame | None:
    """Attachments whose host is left."""
    if attachments is None:
        return None
    hosts = nodes.select(F.lit("node").alias("_k"), F.col("id").alias("_h")).unionAll(edges.select(F.lit("edge"), "id"))
    on = (F.col("host_kind") == F.col("_k")) & (F.col("host_id") == F.col("_h"))
    return attachments.join(hosts.distinct(), on).drop("_k", "_h")
