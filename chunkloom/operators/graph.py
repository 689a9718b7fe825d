"""Relations between chunks and the property graph: extraction, upserts, lookups, paths, vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import stem
from ..session import cut, small

# Reference patterns as (language, link type, regular expression; group 1 is the target).
REFERENCES = (
    ("html", "html_css_link", r"""href=["']([^"']+\.css)["']"""),
    ("html", "html_script_link", r"""<script[^>]+src=["']([^"']+)["']"""),
    ("html", "html_img_link", r"""<img[^>]+src=["']([^"']+)["']"""),
    ("html", "html_link_tag", r"""<link[^>]+href=["']([^"']+)["']"""),
    ("css", "css_import", r"""@import\s+url\(["']?([^"'()]+)["']?\)"""),
    ("css", "css_import", r"""@import\s+["']([^"']+)["']"""),
    ("javascript", "js_import", r"""import\s+.*?from\s+["']([^"']+)["']"""),
    ("javascript", "js_require", r"""require\s*\(\s*["']([^"']+)["']\s*\)"""),
    ("javascript", "js_dynamic_import", r"""import\s*\(\s*["']([^"']+)["']\s*\)"""),
    ("typescript", "js_import", r"""import\s+.*?from\s+["']([^"']+)["']"""),
    ("typescript", "js_require", r"""require\s*\(\s*["']([^"']+)["']\s*\)"""),
    ("typescript", "js_dynamic_import", r"""import\s*\(\s*["']([^"']+)["']\s*\)"""),
    ("python", "python_from_import", r"from\s+(\S+)\s+import"),
    ("python", "python_import", r"import\s+(\S+)"),
    ("rust", "rust_mod", r"mod\s+(\w+)\s*;"),
    ("rust", "rust_use", r"use\s+(?:crate::)?(\w+)"),
    ("go", "go_import", r'import\s+"([^"]+)"'),
    ("java", "java_import", r"import\s+([a-zA-Z_][\w.]*)"),
    ("c_sharp", "csharp_using", r"using\s+([a-zA-Z_][\w.]*)\s*;"),
    ("c", "c_include", r'#include\s+"([^"]+)"'),
    ("cpp", "c_include", r'#include\s+"([^"]+)"'),
    ("ruby", "ruby_require", r"""require\s+["']([^"']+)["']"""),
    ("ruby", "ruby_require_relative", r"""require_relative\s+["']([^"']+)["']"""),
    ("php", "php_require", r"""(?:require|include)(?:_once)?\s+["']([^"']+)["']"""),
    ("swift", "swift_import", r"import\s+(\w+)"),
    ("kotlin", "kotlin_import", r"import\s+([a-zA-Z_][\w.]*)"),
    ("scala", "scala_import", r"import\s+([a-zA-Z_][\w.]*)"),
    ("bash", "bash_source", r"""source\s+["']?([^"'\s]+)["']?"""),
    ("bash", "bash_dot_source", r"""\.\s+["']?([^"'\s]+)["']?"""),
    ("markdown", "markdown_link", r"\[[^\]]*\]\(([^)]+)\)"),
)


#: Chunks of one file up to which a single task puts them in order.
FILE_ROWS = 2_000_000


def next_chunk(chunks: DataFrame, file: Sequence[str], order: Sequence[str], chunk: str = "id", file_rows: int = FILE_ROWS) -> DataFrame:
    """(src, dst) of consecutive chunks of a file in reading order; a chunk doesn't follow itself.

    Files are windows as long as the largest has at most ``file_rows`` chunks. Beyond
    that the chunks are sorted in ranges across all files, so that a file with a
    third of them lies in many tasks, and the ends of the ranges are stitched.
    """
    rows = chunks.select(*file, *[c for c in order if c not in file], *([] if chunk in order else [chunk]))
    largest = rows.groupBy(*file).count().agg(F.max("count")).first()[0]
    if (largest or 0) <= file_rows:
        own = Window.partitionBy(*file).orderBy(*order)
        return rows.select(F.col(chunk).alias("src"), F.lead(chunk).over(own).alias("dst")).where("dst IS NOT NULL AND src <> dst")
    keys = [*file, *order]
    ranged = cut(rows.repartitionByRange(*[F.col(k) for k in keys]).withColumn("_range", F.spark_partition_id()))
    own = Window.partitionBy("_range").orderBy(*keys)
    following = F.lead(F.struct(*file, chunk)).over(own)
    led = ranged.withColumns({"_next": following, "_first": F.row_number().over(own) == 1})
    heads = led.where("_first").select("_range", F.struct(*file, chunk).alias("_head"))
    ends = led.where("_next IS NULL").select("_range").distinct()
    led = led.join(small(_next_heads(heads, ends)), "_range", "left").withColumn("_next", F.coalesce("_next", "_head"))
    same = F.lit(True)
    for k in file:
        same = same & F.col(k).eqNullSafe(F.col(f"_next.{k}"))
    return led.where(F.col("_next").isNotNull() & same).select(F.col(chunk).alias("src"), F.col(f"_next.{chunk}").alias("dst")).where("src <> dst")


def _next_heads(heads: DataFrame, ends: DataFrame) -> DataFrame:
    """(_range, _head): of each range the first row of the next one that has rows; a row per range, of which there are as many as shuffle partitions."""
    own = Window.partitionBy(F.lit(0)).orderBy("_range")
    return heads.select("_range", F.lead("_head").over(own).alias("_head")).join(ends, "_range", "left_semi")


def parent_of(chunks: DataFrame, file: Sequence[str], order: Sequence[str], chunk: str = "id") -> DataFrame:
    """(src, dst) from the first chunk of each file to every other one; the first is an aggregate, so a hot file is one row per task."""
    at = F.struct(*order, chunk)
    first = chunks.groupBy(*file).agg(F.min(at).alias("first")).select(*file, F.col(f"first.{chunk}").alias("src"))
    return chunks.join(first, list(file)).where(F.col(chunk) != F.col("src")).select("src", F.col(chunk).alias("dst"))


def lines(chunks: DataFrame, keep: Sequence[str], text: str = "content") -> DataFrame:
    """(keep..., line_no, line) of every line, from 1."""
    rows = chunks.select(*keep, F.posexplode(F.split(text, r"\r?\n")).alias("line_no", "line"))
    return rows.withColumn("line_no", F.col("line_no") + 1)


def markdown_links(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(keep..., line_no, label, target) of the Markdown links of ``lines``."""
    found = rows.where(F.col("line").contains("](")).select(*keep, "line_no", F.explode(F.regexp_extract_all("line", F.lit(r"\[[^\]]+\]\([^)]+\)"), F.lit(0))).alias("m"))
    return found.select(*keep, "line_no", F.regexp_extract("m", r"^\[([^\]]+)\]", 1).alias("label"), F.regexp_extract("m", r"\(([^)]+)\)$", 1).alias("target"))


def citations(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(keep..., line_no, key) of @cite{key} and [@key]."""
    found = rows.select(*keep, "line_no", F.explode(F.regexp_extract_all("line", F.lit(r"@cite\{[^}]+\}|\[@[^\]]+\]"), F.lit(0))).alias("m"))
    return found.select(*keep, "line_no", F.regexp_replace("m", r"^@cite\{|^\[@|[}\]]$", "").alias("key"))


def fence_files(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(keep..., line_no, filename) of the first code fence of a line that names a file."""
    name = F.regexp_extract("line", r"```\w+\s+([^\s`]+)", 1)
    return rows.where(F.col("line").contains("```")).select(*keep, "line_no", name.alias("filename")).where("filename <> ''")


def _targets(text: str, kind: str, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda t: F.struct(F.lit(kind).alias("link_type"), t.alias("target")))


def references(chunks: DataFrame, keep: Sequence[str], language: str = "language", text: str = "content") -> DataFrame:
    """(keep..., link_type, target, name) of imports and links by the patterns of the chunk's language; ``name`` is the bare stem."""
    found = F.array().cast("array<struct<link_type:string,target:string>>")
    for known in dict.fromkeys(x[0] for x in REFERENCES):
        own = [_targets(text, kind, pattern) for name, kind, pattern in REFERENCES if name == known]
        found = F.when(F.col(language) == known, F.concat(*own)).otherwise(found)
    rows = chunks.select(*keep, F.explode(found).alias("r")).select(*keep, "r.link_type", "r.target")
    bare = F.regexp_replace(F.regexp_replace("target", r"^(?:\./)+", ""), r"^(?:\.\./)+", "")
    return rows.withColumn("name", stem(bare)).where("name <> ''")


def edge_upsert(stored: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """Edges (src, dst, type, confidence) merged by (src, dst, type); of several incoming ones the last by ``order`` survives."""
    both = stored.withColumn("_at", F.lit(None).cast(dict(incoming.dtypes)[order])).drop(order).unionByName(incoming.withColumn("_at", F.col(order)).drop(order))
    top = F.max(F.struct(F.col("_at"), F.col("confidence"))).alias("r")
    return both.groupBy("src", "dst", "type").agg(top).select("src", "dst", "type", F.col("r.confidence").alias("confidence"))


def placeholders(nodes: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """Nodes and, of edge ends that aren't among them, rows with only a key."""
    ends = edges.select(F.col("src").alias(key)).unionByName(edges.select(F.col("dst").alias(key))).distinct()
    return nodes.unionByName(ends.join(nodes.select(key), key, "left_anti"), allowMissingColumns=True)


def linked_pages(pages: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, links) after writing ``links`` (src, dst) between pages by url: a link whose source isn't there is dropped, a target that isn't is created."""
    kept = links.join(pages.select(F.col("url").alias("src")), "src", "left_semi").select("src", "dst").distinct()
    return placeholders(pages, kept, "url"), kept


def graph_sync(chunks: DataFrame, file: Sequence[str], order: Sequence[str], chunk: str = "id") -> DataFrame:
    """(src, dst, type, confidence): reading order and parenthood of all files, each edge once."""
    one = next_chunk(chunks, file, order, chunk).select("src", "dst", F.lit("NEXT_CHUNK").alias("type"))
    two = parent_of(chunks, file, order, chunk).select("src", "dst", F.lit("PARENT_OF").alias("type"))
    return one.unionByName(two).distinct().withColumn("confidence", F.lit(1.0))


def detached(nodes: DataFrame, edges: DataFrame, gone: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Nodes without those in ``gone`` and edges without the ones that touch them."""
    ids = gone.select(F.col(key).alias("_k")).distinct()
    left = edges.join(ids, F.col("src") == F.col("_k"), "left_anti").join(ids, F.col("dst") == F.col("_k"), "left_anti")
    return nodes.join(ids, F.col(key) == F.col("_k"), "left_anti"), left


def graph_stats(nodes: DataFrame, edges: DataFrame, group: str = "source_id", key: str = "id") -> DataFrame:
    """(group, chunk_count, relationship_count): nodes with and without outgoing edges; edges are counted per node before the join."""
    out = edges.groupBy(F.col("src").alias(key)).agg(F.count("*").alias("n"))
    return nodes.select(group, key).distinct().join(out, key, "left").groupBy(group).agg(F.count("*").alias("chunk_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("relationship_count"))


def shortest_path(edges: DataFrame, start: object, goal: object, max_steps: int | None = None) -> DataFrame:
    """(step, node) of a shortest path over undirected edges; of several parents the least is taken; no rows if there is none.

    One join of the frontier per step. Each step is a table of its own, written once;
    the driver sees only whether the goal was reached, and the path at the end. With
    ``max_steps`` a longer path is an error.
    """
    both = cut(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))).where("a <> b").distinct())
    spark = edges.sparkSession
    kind = dict(both.dtypes)["a"]
    steps = [spark.createDataFrame([(start, None)], f"node {kind}, parent {kind}")]
    while steps[-1].where(F.col("node") == F.lit(goal)).isEmpty():
        if max_steps is not None and len(steps) > max_steps:
            raise RuntimeError(f"shortest_path: more than {max_steps} steps")
        found = both.join(steps[-1].select(F.col("node").alias("a")), "a").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        # A node next to the frontier was reached in the two steps before, if it was reached at all.
        for before in steps[-2:]:
            found = found.join(before.select("node"), "node", "left_anti")
        fresh = cut(found)
        if fresh.isEmpty():
            return spark.createDataFrame([], f"step int, node {kind}")
        steps.append(fresh)
    path, at = [], goal
    for k in range(len(steps) - 1, -1, -1):
        path.append((k, at))
        if k:
            at = steps[k].where(F.col("node") == F.lit(at)).first()["parent"]
    return spark.createDataFrame(path, f"step int, node {kind}")


def nearest(rows: DataFrame, queries: DataFrame, k: int, threshold: float | None = None, key: str = "vec_id", vector: str = "embedding", owner: str | None = None, owner_value: Column | None = None, block_bytes: int = 64_000_000) -> DataFrame:
    """(query, key, score) of the ``k`` rows of greatest cosine per query over all rows, then of those the ones at ``threshold`` and of the owner.

    The query set goes to the tasks in blocks of bounded size. Each task keeps its
    own best k per query, so what is shuffled doesn't grow with the rows of a task.
    Ties fall to the smaller key. Null vectors, and vectors of another length than
    the query, have no score.
    """
    spark = rows.sparkSession
    block: list[tuple] = []
    size = 0
    out = None
    kinds = dict(rows.dtypes)[key]

    def part(block: list[tuple]) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids = [q for q, _ in sent.value]
            width = len(sent.value[0][1])
            wanted = np.asarray([v for _, v in sent.value], np.float64)
            wanted /= np.maximum(np.linalg.norm(wanted, axis=1, keepdims=True), 1e-300)
            best: list[list[tuple]] = [[] for _ in ids]
            named = pa.int64()
            for batch in batches:
                names, named = batch.column(0).to_pylist(), batch.schema.field(0).type
                vectors = batch.column(1).to_pylist()
                good = [i for i, v in enumerate(vectors) if v is not None and len(v) == width and None not in v]
                if not good:
                    continue
                own = np.asarray([vectors[i] for i in good], np.float64)
                scores = np.round((wanted @ (own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-300)).T), 6)
                for q in range(len(ids)):
                    top = np.argpartition(-scores[q], min(k, len(good)) - 1)[:k] if len(good) > k else range(len(good))
                    least = min((scores[q][i] for i in top), default=0.0)
                    best[q] += [(-scores[q][i], names[good[i]]) for i in np.flatnonzero(scores[q] >= least)]
                    best[q] = sorted(best[q])[:k]
            flat = [(ids[q], n, -s) for q in range(len(ids)) for s, n in best[q]]
            if flat:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat, strict=True), (named, named, pa.float64()), strict=True)], names=["query", key, "score"])

        return rows.select(key, vector).mapInArrow(run, f"query {kinds}, {key} {kinds}, score double")

    by_width: dict[int, list[tuple]] = {}
    for row in queries.select(key, vector).where(F.col(vector).isNotNull()).toLocalIterator():
        block = by_width.setdefault(len(row[1]), [])
        block.append((row[0], list(row[1])))
        size = len(block) * 8 * len(row[1])
        if size >= block_bytes:
            out = part(block) if out is None else out.unionByName(part(block))
            by_width[len(row[1])] = []
    for block in by_width.values():
        if block:
            out = part(block) if out is None else out.unionByName(part(block))
    if out is None:
        return spark.createDataFrame([], f"query {kinds}, {key} {kinds}, score double")
    own = Window.partitionBy("query").orderBy(F.desc("score"), key)
    found = out.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).drop("rank")
    if owner is not None:
        found = found.join(rows.select(key, owner), key).where(F.col(owner) == owner_value)
    return found.where(F.col("score") >= threshold).select("query", key, "score") if threshold is not None else found.select("query", key, "score")


#: Names that one automaton holds, and bytes of content of a source that one task scans with it.
NAMES_AT_ONCE, BYTES_AT_ONCE = 50_000, 64 << 20


def _scan_for_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk_id, source_id, filename, name) of rows (source_id, block, salt, chunk_id, filename, text) sorted by group; rows without a chunk are the names of the group and come first."""
    import ahocorasick

    group, found, automaton = None, set(), None
    for batch in batches:
        out: list[tuple] = []
        for source, block, salt, is_text, chunk, filename, text in zip(*[batch.column(k).to_pylist() for k in range(7)], strict=True):
            if (source, block, salt) != group:
                group, automaton = (source, block, salt), ahocorasick.Automaton()
            if not is_text:
                automaton.add_word(text, text)
                continue
            if automaton.kind == ahocorasick.TRIE:
                automaton.make_automaton()
            if automaton.kind == ahocorasick.AHOCORASICK:
                found = {name for _, name in automaton.iter(text)}
                out += [(chunk, source, filename, name) for name in found]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names=["chunk_id", "source_id", "filename", "name"])


def containing(chunks: DataFrame, files: DataFrame, names_at_once: int = NAMES_AT_ONCE, bytes_at_once: int = BYTES_AT_ONCE) -> DataFrame:
    """(chunk_id, target): chunks whose content contains the name of another file of their source, wherever it stands.

    ``chunks`` are (chunk_id, source_id, filename, content), ``files`` (source_id,
    target, name). The distinct names of a source make automata of bounded size, its
    contents are spread over tasks of bounded size, and every content is scanned once
    per automaton. Names that were found become files by an equality join. Null and
    empty names and contents give nothing, repeated rows count once.
    """
    names = files.where("name <> ''").select("source_id", "name").distinct()
    texts = chunks.where("content <> ''").select("chunk_id", "source_id", "filename", "content").distinct()
    blocks = names.groupBy("source_id").agg(F.ceil(F.count("*") / names_at_once).cast("int").alias("blocks"))
    salts = texts.groupBy("source_id").agg(F.ceil(F.sum(F.octet_length("content")) / bytes_at_once).cast("int").alias("salts"))
    sizes = blocks.join(salts, "source_id")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    block = F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int").alias("block")
    none = F.lit(None).cast("string")
    wanted = names.join(sizes, "source_id").select("source_id", block, every("salts").alias("salt"), F.lit(False).alias("is_text"), none.alias("chunk_id"), none.alias("filename"), F.col("name").alias("text"))
    salt = F.pmod(F.xxhash64("chunk_id"), F.col("salts")).cast("int").alias("salt")
    scanned = texts.join(sizes, "source_id").select("source_id", every("blocks").alias("block"), salt, F.lit(True).alias("is_text"), "chunk_id", "filename", F.col("content").alias("text"))
    group = ["source_id", "block", "salt"]
    rows = wanted.unionByName(scanned).repartition(*group).sortWithinPartitions(*group, "is_text")
    hits = rows.mapInArrow(_scan_for_names, "chunk_id string, source_id string, filename string, name string")
    # Repeats go before names become files, as a common name stands for many of them; afterwards nothing is shuffled.
    return hits.distinct().join(files.select("source_id", "name", "target").distinct(), ["source_id", "name"]).where("target <> filename").select("chunk_id", "target")
