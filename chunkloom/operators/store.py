"""The graph store as tables: merging nodes and edges, resolving and matching ends, consuming embeddings, deleting sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .changes import newest, upsert
from .events import embedding_rows, with_embeddings
from .graph import references

#: An entity: its key is the qualified name.
ENTITY = ("qualified_name", "id", "name", "entity_type", "source_id", "file_path", "start_line", "end_line", "signature", "visibility", "metadata", "owner_id")
#: A repository: its key is the id.
REPOSITORY = ("id", "name", "url", "branch", "commit_hash", "repo_type", "owner_id")


def without_nul(text: Column) -> Column:
    """The text without NUL characters, which end a string in some stores."""
    return F.replace(text, F.lit("\0"), F.lit(""))


def merge_nodes(stored: DataFrame, incoming: DataFrame, key: str, now: Column, order: Sequence[str] = (), fill: Sequence[str] = ()) -> DataFrame:
    """``stored`` nodes (with created_at, updated_at) after writing ``incoming`` ones, one row per key.

    Of several writes the greatest by ``order``, then by all columns, holds. A node that
    is new gets created_at, one that exists keeps it, both get updated_at. Columns in
    ``fill``, such as an embedding, are changed only by a value; NUL characters are
    taken out of all texts. Rows without a key are left out.
    """
    columns = [c for c in stored.columns if c not in ("created_at", "updated_at")]
    kinds = dict(incoming.dtypes)
    clean = [without_nul(F.col(c)).alias(c) if kinds[c] == "string" else F.col(c) for c in incoming.columns]
    last = newest(incoming.where(F.col(key).isNotNull()).select(*clean), [key], list(order) or [key])
    rows = last.select(*columns, now.alias("created_at"), now.alias("updated_at"))
    return upsert(stored, rows.select(*stored.columns), [key], kept=["created_at"], fill=fill)


def entities(rows: DataFrame) -> DataFrame:
    """Entities as they are stored: no signature reads as an empty one, no visibility as public, no metadata as {}."""
    defaults = {"signature": "", "visibility": "public", "metadata": "{}"}
    return rows.select(*[F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in rows.columns])


def merge_edges(stored: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """Edges (src, dst, type and properties) after writing ``incoming`` ones: one edge per ends and type with all properties of its last writer by ``order``."""
    key = ["src", "dst", "type"]
    rest = [c for c in stored.columns if c not in key]
    old = stored.select(*key, F.struct(F.lit(None).cast(dict(incoming.dtypes)[order]).alias("at"), *rest).alias("r"))
    new = incoming.select(*key, F.struct(F.col(order).alias("at"), *rest).alias("r"))
    return old.unionByName(new).groupBy(*key).agg(F.max("r").alias("r")).select(*key, *[F.col(f"r.{c}").alias(c) for c in rest])


def resolved(edges: DataFrame, names: DataFrame, key: str, name: str) -> DataFrame:
    """``edges`` between ids as edges between the names that (key, name) has for them; an edge with an unknown end is dropped, a repeated id has one name, the least."""
    known = names.groupBy(key).agg(F.min(name).alias(name))
    for end in ("src", "dst"):
        one = known.select(F.col(key).alias(end), F.col(name).alias(f"_{end}"))
        edges = edges.join(one, end).drop(end).withColumnRenamed(f"_{end}", end)
    return edges


def matched(edges: DataFrame, sources: DataFrame, targets: DataFrame, source_key: str, target_key: str) -> DataFrame:
    """The edges whose two ends exist; nothing is created for the others."""
    kept = edges.join(sources.select(F.col(source_key).alias("src")).distinct(), "src", "left_semi")
    return kept.join(targets.select(F.col(target_key).alias("dst")).distinct(), "dst", "left_semi").select(*edges.columns)


def file_names(identifier: Column) -> Column:
    """array<string>: every name that a composite id (parts by |, paths by /) holds behind | or / and before a dot or |."""
    parts = F.split(identifier, r"\|")

    def of(part: Column, k: Column) -> Column:
        steps = F.split(part, "/")

        def prefixes(step: Column, i: Column) -> Column:
            dots = F.split(step, r"\.")
            found = F.transform(F.sequence(F.lit(1), F.greatest(F.size(dots) - 1, F.lit(1))), lambda n: F.array_join(F.slice(dots, F.lit(1), n), "."))
            found = F.when(F.size(dots) > 1, found).otherwise(F.array().cast("array<string>"))
            last = (i == F.size(steps) - 1) & (k < F.size(parts) - 1)
            return F.when((k == 0) & (i == 0), F.array().cast("array<string>")).when(last, F.concat(found, F.array(step))).otherwise(found)

        return F.flatten(F.transform(steps, prefixes))

    return F.array_distinct(F.flatten(F.transform(parts, of)))


def consumed(messages: DataFrame, nodes: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after reading embedding messages, as one plan.

    Nodes have id, source_id, language, content, embedding and model. Chunks of a
    message whose node isn't there are skipped. For the others the embedding is set and
    edges are made: NEXT_CHUNK to the chunk that follows in its message, which is
    created if it isn't there, and LINKS_TO with the link type to every node of the
    message's source whose id names a file that the content refers to.
    """
    rows = embedding_rows(messages, value)
    own = Window.partitionBy("event_id").orderBy("pos")
    led = rows.select("event_id", "pos", "source_id", "id", F.lead("id").over(own).alias("following"))
    known = led.join(nodes.select("id", "language", "content"), "id")
    follows = known.where("following IS NOT NULL").select(F.col("id").alias("src"), F.col("following").alias("dst"), F.lit("NEXT_CHUNK").alias("type"), F.lit("").alias("link_type")).distinct()
    named = references(known.select("id", "source_id", "language", "content").distinct(), ["id", "source_id"]).select("id", "source_id", "link_type", "name").distinct()
    files = nodes.select(F.col("id").alias("dst"), "source_id", F.explode(file_names(F.col("id"))).alias("name"))
    links = named.join(files, ["source_id", "name"]).where("id <> dst").select(F.col("id").alias("src"), "dst", F.lit("LINKS_TO").alias("type"), "link_type").distinct()
    updated = with_embeddings(nodes, rows)
    fresh = follows.select(F.col("dst").alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")
    return updated.unionByName(fresh, allowMissingColumns=True), follows.unionByName(links)


def delete_source(tables: dict[str, DataFrame], source: str, column: str = "source_id") -> tuple[dict[str, DataFrame], DataFrame]:
    """(the tables without the rows of a source, (name, removed) counts); rows without a source stay."""
    left = {name: rows.where(~F.coalesce(F.col(column) == source, F.lit(False))) for name, rows in tables.items()}
    counts = None
    for name, rows in tables.items():
        gone = rows.where(F.col(column) == source).agg(F.lit(name).alias("name"), F.count("*").alias("removed"))
        counts = gone if counts is None else counts.unionByName(gone)
    return left, counts
