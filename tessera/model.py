"""The typed graph: node kinds, relations, ids and the shape of the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds of nodes, in order.
NODE_KINDS = (
    "TextUnit", "Container", "Event", "Narrative", "Place", "Person", "Anchor", "Era", "Polity", "CatechismItem",
    "Source", "Translation", "PeopleGroup", "CommentaryItem", "LexiconEntry", "Map",
)

# Directed relations with their forward and inverse labels.
DIRECTED = {
    "Contains": ("contains", "member-of"),
    "Attests": ("attested-in", "attests"),
    "Succession": ("follows-in", "precedes-in"),
    "DatedBy": ("dated-by", "dates"),
    "LocatedAt": ("located-at", "site-of"),
    "Mentions": ("mentions", "mentioned-in"),
    "Cites": ("cites", "cited-by"),
    "Quotes": ("quotes", "quoted-by"),
    "Confesses": ("confesses", "confessed-in"),
    "Fulfillment": ("fulfilled-in", "fulfills"),
    "Typology": ("prefigures", "prefigured-by"),
    "NamedAfter": ("named-after", "namesake-of"),
    "JustifiedBy": ("justified-by", "justifies"),
    "CommentsOn": ("comments-on", "commented-on-by"),
    "SpokenBy": ("spoken-by", "speech-of"),
    "SpokenAt": ("spoken-at", "site-of-speech"),
    "DerivedFrom": ("derived-from", "derives"),
    "Occurs": ("occurs-in", "words"),
    "ParentOf": ("parent-of", "child-of"),
    "Participates": ("participates-in", "participants"),
    "AuthoredBy": ("authored-by", "authored"),
    "Shows": ("shows", "shown-on"),
}
# Symmetric relations and their labels.
SYMMETRIC = {
    "Analogue": "analogous-to",
    "CatechismLink": "catechism-link",
    "Corresponds": "corresponds-to",
    "Parallel": "parallel",
    "TemporalAdjacency": "temporal-adjacency",
    "Spouses": "spouse-of",
    "Brethren": "brethren-of",
}
#: Symmetric relations are numbered from here.
SYMMETRIC_CODE = 128

#: Columns of lowered rows: what every row family becomes.
ROW_SCHEMA = "family int, row_ord long, rel string, subject string, object string, votes long, narrative string, provenance string"


def edge_kinds(spark: SparkSession) -> DataFrame:
    """``rel, dir, label, code, kind_order``: every edge kind in canonical order."""
    rows = []
    for code, (rel, (forward, inverse)) in enumerate(DIRECTED.items()):
        rows += [(rel, "forward", forward, code), (rel, "inverse", inverse, code)]
    rows += [(rel, "both", label, SYMMETRIC_CODE + k) for k, (rel, label) in enumerate(SYMMETRIC.items())]
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "rel string, dir string, label string, code int, kind_order int")


def dual_label(label: str) -> str:
    """The label of the same relation seen from the other end."""
    for forward, inverse in DIRECTED.values():
        if label in (forward, inverse):
            return inverse if label == forward else forward
    if label in SYMMETRIC.values():
        return label
    raise ValueError(f"bad_kind: {label}")


def node_id(kind: str, raw: Column | str) -> Column:
    raw = F.col(raw) if isinstance(raw, str) else raw
    return F.concat(F.lit(f"{kind}:"), raw.cast("string"))


def kind_of(node: Column) -> Column:
    return F.substring_index(node, ":", 1)


def raw_of(node: Column) -> Column:
    """What follows the first colon."""
    return F.regexp_extract(node, r"^[^:]*:(.*)$", 1)


def is_symmetric(rel: Column) -> Column:
    return rel.isin(*SYMMETRIC)


def content_hash(*parts: Column) -> Column:
    """128 bits of SHA-256 over parts joined by line feeds, in hexadecimal."""
    return F.substring(F.sha2(F.concat_ws("\n", *parts), 256), 1, 32)


def edge_id(rel: Column, subject: Column, obj: Column) -> Column:
    """One id for an edge; the ends of a symmetric edge count in byte order."""
    both = is_symmetric(rel)
    low = F.when(both, F.least(subject, obj)).otherwise(subject)
    high = F.when(both, F.greatest(subject, obj)).otherwise(obj)
    return F.concat(rel, F.lit(":"), content_hash(rel, low, high))
