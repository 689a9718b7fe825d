"""Queries of the engine's own operators, each with the SQL that checks it where SQL can say it."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as T
from ..operators import changes, chunking, contracts, events, graph, identity, limits, parsing, store
from ..session import shared_folder
from ..sources import files as sources
from ..sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_BASE = "regexp_extract(filename, '[^/]*$')"
_EXT = f"lower(regexp_extract({_BASE}, '^.+\\.([^.]*)$', 1))"
_TRIM = r"regexp_replace({0}, '^[\t-\r \x{{85}}\p{{Z}}]+|[\t-\r \x{{85}}\p{{Z}}]+$', '', 'g')"
_CHUNKS = "(SELECT DISTINCT chunk_id, source_id, filename, content, start_line, end_line FROM chunk_data)"


# What the SQL checks expect of an extension, and the relation types; written here so that they don't follow the engine's tables.
_LANGUAGE_SQL = "CASE WHEN ext IN ('py') THEN 'python' " + " ".join(f"WHEN ext IN ({', '.join(repr(e) for e in exts.split())}) THEN '{name}'" for name, exts in {
    "rust": "rs", "javascript": "js jsx mjs cjs", "typescript": "ts tsx mts cts", "go": "go", "java": "java", "c": "c", "cpp": "h hpp hxx cpp cc cxx", "c_sharp": "cs", "ruby": "rb", "php": "php", "swift": "swift", "kotlin": "kt kts",
    "scala": "scala sc", "bash": "sh bash zsh", "html": "html htm", "css": "css scss less", "markdown": "md markdown"}.items()) + " END"
_DISPLAY_SQL = "CASE last WHEN 'rs' THEN 'Rust' WHEN 'py' THEN 'Python' WHEN 'js' THEN 'JavaScript' WHEN 'ts' THEN 'TypeScript' WHEN 'go' THEN 'Go' WHEN 'java' THEN 'Java' WHEN 'cpp' THEN 'C++' WHEN 'c' THEN 'C' WHEN 'h' THEN 'C' WHEN 'hpp' THEN 'C++' WHEN 'rb' THEN 'Ruby' WHEN 'php' THEN 'PHP' WHEN 'swift' THEN 'Swift' WHEN 'kt' THEN 'Kotlin' WHEN 'scala' THEN 'Scala' END"
_MIME_SQL = "CASE WHEN ext = 'pdf' THEN 'application/pdf' WHEN ext IN ('png', 'webp', 'bmp', 'gif') THEN 'image/' || ext WHEN ext IN ('jpg', 'jpeg') THEN 'image/jpeg' WHEN ext IN ('tif', 'tiff') THEN 'image/tiff' ELSE 'application/octet-stream' END"
_DOCUMENT_SQL = "CASE WHEN ext IN ('pdf', 'docx', 'doc', 'rtf', 'html', 'markdown') THEN ext WHEN ext = 'htm' THEN 'html' WHEN ext = 'md' THEN 'markdown' WHEN ext = 'txt' THEN 'text' ELSE 'unknown' END"
_RELATION_SQL = """FunctionCalls CALLS code, ApiCalls API_CALLS code, ClassInherits INHERITS code, FileImports IMPORTS code, ClassContainsMethod CONTAINS_METHOD code, FunctionReferencesVariable REFERENCES code, DefinedIn DEFINED_IN code,
Implements IMPLEMENTS code, Tests TESTS code, Instantiates INSTANTIATES code, TypeReference TYPE_REF code, Decorates DECORATES code, ReferencedIn REFERENCED_IN document, DocumentReferencesDoc LINKS_TO document, HyperlinkReference HYPERLINKS_TO web,
CanonicalUrl CANONICAL_OF web, ThreadReply REPLIES_TO conversation, MentionReference MENTIONS conversation, TopicContinuation CONTINUES_TOPIC conversation, ForeignKeyRelation FOREIGN_KEY schema, ApiEndpointUsesModel USES_MODEL schema,
ActionItemFromDecision ACTION_FROM_DECISION transcript, QaPair ANSWERS transcript, SpeakerTurnSequence FOLLOWED_BY transcript, NextChunk NEXT_CHUNK hierarchy, ParentChild PARENT_OF hierarchy, Sibling SIBLING_OF hierarchy, Configures CONFIGURES structural,
DependsOn DEPENDS_ON structural, SameSource SAME_SOURCE structural"""


def _trim(x: str) -> str:
    return _TRIM.format(x)


def _chunks(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return table(spark, sf_dir, "chunk_data", ["chunk_id", "source_id", "filename", *more]).distinct()


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "file_metadata", ["source_id", "filename"]).distinct()


# --- scans and classifiers -----------------------------------------------------------------------


@_query(f"SELECT source_id, filename, ext, CASE WHEN ext IN ('pdf', 'docx', 'pptx', 'doc', 'ppt', 'rtf', 'epub', 'md', 'markdown') THEN 'document' ELSE 'hybrid' END AS route, {_DOCUMENT_SQL} AS doc_type FROM (SELECT DISTINCT source_id, filename, {_EXT} AS ext FROM file_metadata)")
def sc_route_by_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route and document type of every file."""
    f = F.col("filename")
    return _files(spark, sf_dir).select("source_id", "filename", N.extension(f).alias("ext"), N.route(f).alias("route"), N.document_type(f).alias("doc_type"))


@_query(f"""
SELECT split_part(filename, '/', 1) AS folder, count(*) AS files, sum(size_bytes) AS bytes FROM file_metadata
WHERE len(list_filter(string_split(filename, '/'), lambda s: s LIKE '.%' OR s IN ('node_modules', '__pycache__', 'target', 'dist', 'build'))) = 0 AND size_bytes <= 5242880 GROUP BY 1""")
def sc_tree_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a scan keeps: no hidden or pruned folder, at most 5 MiB."""
    files = table(spark, sf_dir, "file_metadata", ["filename", "size_bytes"]).where(F.col("size_bytes") <= 5 * 1024 * 1024).where(N.kept_path(F.col("filename")))
    return files.groupBy(F.split_part("filename", F.lit("/"), F.lit(1)).alias("folder")).agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


@_query("SELECT doc_id, sha256(text) AS hash, CAST(NULL AS VARCHAR) AS problem FROM documents WHERE text IS NOT NULL UNION ALL SELECT -doc_id, NULL, 'invalid base64' FROM documents WHERE text IS NOT NULL")
def sc_payload_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inline payloads, half of them in base64, and each again as broken base64."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"]).where("text IS NOT NULL")
    coded = F.col("doc_id") % 2 == 1
    sent = docs.select("doc_id", F.when(coded, F.base64(F.encode("text", "UTF-8"))).otherwise(F.col("text")).alias("content"), coded.alias("is_base64"))
    broken = docs.select((-F.col("doc_id")).alias("doc_id"), F.concat(F.lit("%"), "text").alias("content"), F.lit(True).alias("is_base64"))
    return sources.decoded(sent.unionByName(broken)).select("doc_id", F.sha2("text", 256).alias("hash"), "problem")


_FOLDERS = ("src", "_private", ".git", "a/node_modules", "a/build", "deep/er/__tests__", "target", "docs/.hidden")


@_query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, ['src', '_private', '.git', 'a/node_modules', 'a/build', 'deep/er/__tests__', 'target', 'docs/.hidden'][doc_id % 8 + 1] AS folder,
['_x.py', 'read me.md', '__init__.py', 'c.txt', '.env', 'deck.pptx'][doc_id % 6 + 1] AS ending FROM documents)
SELECT folder || '/' || doc_id || '/' || ending AS filename, CAST(strlen(text) AS BIGINT) AS size_bytes, sha256(text) AS hash, CASE WHEN regexp_matches(ending, 'md$|pptx$') THEN 'document' ELSE 'hybrid' END AS route
FROM d WHERE folder IN ('src', '_private', 'deep/er/__tests__') AND ending <> '.env' AND strlen(text) <= 5242880""")
def sc_scan_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as files of a tree, and the tree scanned again: hidden and build folders aren't entered, underscores don't hide."""
    endings = ("_x.py", "read me.md", "__init__.py", "c.txt", ".env", "deck.pptx")
    root = f"{shared_folder(spark).removeprefix('file://').removeprefix('file:')}/tree-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folder = f"{root}/{_FOLDERS[key % len(_FOLDERS)]}/{key}"
                os.makedirs(folder, exist_ok=True)
                with open(f"{folder}/{endings[key % len(endings)]}", "wb") as f:
                    f.write((text or "").encode("utf-8", "surrogatepass"))
            yield batch.select([0])

    docs.mapInArrow(written, "doc_id bigint").count()
    return sources.scan_folder(spark, root, "tree").select("filename", "size_bytes", F.sha2("content", 256).alias("hash"), "route")


@_query(f"""
SELECT source_id, filename, lang, {_DISPLAY_SQL} AS display, {_MIME_SQL} AS mime, CASE WHEN lang IS NOT NULL THEN 'code:File' WHEN filename LIKE 'http%' THEN 'web:PageOverview' ELSE 'doc:DocumentOverview' END AS chunk_type
FROM (SELECT *, {_LANGUAGE_SQL} AS lang FROM (SELECT DISTINCT source_id, filename, {_EXT} AS ext, lower(string_split(filename, '.')[-1]) AS last FROM file_metadata))""")
def pr_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, display name, MIME type and chunk type of every file."""
    f = F.col("filename")
    return _files(spark, sf_dir).select("source_id", "filename", N.language(f).alias("lang"), N.display_language(f).alias("display"), N.mime_type(f).alias("mime"), N.chunk_type(f).alias("chunk_type"))


@_query(f"SELECT chunk_id, source_id || '|' || filename || '|' || chunk_id AS composite, filename AS path, source_id || '/' || filename AS repo_path, {_BASE} AS file_name, regexp_replace({_BASE}, '(.)\\.[^.]*$', '\\1') AS stem FROM {_CHUNKS}")
def pr_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite ids and what is read back from them."""
    f = F.col("filename")
    rows = _chunks(spark, sf_dir).withColumn("composite", N.composite_id(F.col("source_id"), f, F.col("chunk_id")))
    return rows.select("chunk_id", "composite", N.composite_path(F.col("composite")).alias("path"), F.concat_ws("/", "source_id", "filename").alias("repo_path"), N.basename(f).alias("file_name"), N.stem(f).alias("stem"))


@_query(r"""
WITH s AS (SELECT output_id, sections, tables, unnest(range(1, len(sections) + 1)) AS pos FROM (SELECT DISTINCT output_id, sections, tables FROM pipeline_output)),
c AS (SELECT output_id, pos - 1 AS pos, string_split(sections[pos].content, chr(10)) AS lines, sections[pos].content AS content FROM s WHERE sections[pos].content IS NOT NULL)
SELECT output_id, CAST(pos AS INTEGER) AS pos, len(list_filter(lines, lambda x: len(string_split(x, '|')) > 3)) > 3
  OR ((contains(content, 'TABLE ') OR contains(content, 'Table ') OR contains(content, 'table:'))
  AND len(list_filter(lines, lambda x: len(list_filter(regexp_split_to_array(x, '[\t-\r \x{85}\p{Z}]+'), lambda w: w <> '')) >= 4)) > 5) AS likely FROM c""")
def pr_table_likely(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section contents that look like tables."""
    outputs = table(spark, sf_dir, "pipeline_output", ["output_id", "sections", "tables"]).distinct()
    parts = outputs.select("output_id", F.posexplode(F.col("sections.content")).alias("pos", "content")).where("content IS NOT NULL")
    return parts.select("output_id", "pos", T.table_likely(F.col("content")).alias("likely"))


@_query(r"""
WITH o AS (SELECT DISTINCT output_id, sections, tables FROM pipeline_output),
f AS (SELECT *, list_transform(coalesce(sections, []), lambda s: coalesce(s.content, '')) AS c FROM o),
g AS (SELECT *, coalesce(list_sum(list_transform(c, lambda x: strlen(x))), 0) AS total, len(list_filter(c, lambda x: len(list_filter(string_split(x, chr(10)), lambda l: len(string_split(l, '|')) > 3)) > 3
  OR ((contains(x, 'TABLE ') OR contains(x, 'Table ') OR contains(x, 'table:')) AND len(list_filter(string_split(x, chr(10)), lambda l: len(list_filter(regexp_split_to_array(l, '[\t-\r \x{85}\p{Z}]+'), lambda w: w <> '')) >= 4)) > 5))) > 0 AS likely FROM f)
SELECT output_id, NOT (coalesce(len(tables), 0) = 0 AND (total < 50 OR likely)) AS sufficient FROM g""")
def pr_sufficient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a parse may be kept as it is."""
    return parsing.sufficient(table(spark, sf_dir, "pipeline_output", ["output_id", "sections", "tables"]).distinct(), ["output_id"])


@_query("""SELECT DISTINCT chunk_id, round(greatest(0, least(1, CAST(quality_score AS DOUBLE))), 6) AS confidence, (quality_score IS NOT NULL AND CAST(quality_score AS DOUBLE) < 0.7) OR coalesce(end_line - start_line > 70, false) AS asked,
CASE WHEN ((quality_score IS NOT NULL AND CAST(quality_score AS DOUBLE) < 0.7) OR coalesce(end_line - start_line > 70, false)) AND quality_score IS NOT NULL THEN 'enhanced' ELSE 'structural' END AS tier FROM chunk_data""")
def pr_enhance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural chunks of low confidence or high complexity, here a tenth of their lines, move a tier on; confidences are clamped."""
    rows = _chunks(spark, sf_dir, "quality_score", "start_line", "end_line").select("chunk_id", F.col("quality_score").cast("double").alias("q"), ((F.col("end_line") - F.col("start_line")) / 10).alias("complexity")).distinct()
    asked = contracts.needs_enhancement(F.lit("structural"), F.col("q"), F.col("complexity"))
    rows = rows.select("chunk_id", F.round(T.clamp(F.col("q")), 6).alias("confidence"), asked.alias("asked"), F.lit("structural").alias("tier"), F.when(asked, F.col("q")).alias("quality"), F.lit(None).cast("timestamp").alias("enhanced_at"))
    return contracts.advanced(rows, F.current_timestamp()).select("chunk_id", "confidence", "asked", "tier")


@_query(f"""
SELECT chunk_id, regexp_matches(content, '(?i)AKIA[0-9A-Z]{{16}}') AS has_key_id, regexp_matches(content, '-----BEGIN [A-Z ]+ PRIVATE KEY-----') AS has_private_key FROM {_CHUNKS}
WHERE regexp_matches(content, '(?i)AKIA[0-9A-Z]{{16}}') OR regexp_matches(content, '-----BEGIN [A-Z ]+ PRIVATE KEY-----')""")
def pr_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with a pattern of a secret."""
    rows = _chunks(spark, sf_dir, "content").select("chunk_id", T.secret_findings(F.col("content")).alias("found")).where(F.size("found") > 0)
    return rows.select("chunk_id", F.array_contains("found", "aws_access_key").alias("has_key_id"), F.array_contains("found", "private_key").alias("has_private_key"))


@_query(f"SELECT parts[1] AS type, parts[2] AS label, parts[3] AS category, upper(parts[1]) AS bare FROM (SELECT string_split(trim(r), ' ') AS parts FROM (SELECT unnest(string_split(replace('{_RELATION_SQL}', chr(10), ' '), ',')) AS r))")
def pr_relation_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relation types with label, category and bare name."""
    return spark.createDataFrame(N.RELATIONS, "type string, label string, category string").withColumn("bare", N.relation_label(F.concat("type", F.lit(" -!"))))


@_query("SELECT topic, count(*) AS deliveries, count(*) FILTER (abs(CAST(floor(epoch(received_at)) AS BIGINT) - CAST(floor(epoch(timestamp)) AS BIGINT)) > 300) AS stale FROM chunk_events GROUP BY topic")
def pr_stale_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries over 300 seconds from their own time, by topic."""
    rows = table(spark, sf_dir, "chunk_events", ["topic", "received_at", "timestamp"])
    stale = contracts.is_stale(F.col("timestamp").cast("timestamp"), F.col("received_at").cast("timestamp"))
    return rows.groupBy("topic").agg(F.count("*").alias("deliveries"), F.count_if(stale).alias("stale"))


@_query("""
SELECT CASE WHEN retried THEN coalesce(trim(string_split(repo_name || ', 10.0.0.1', ',')[1]), source_id, 'unknown') ELSE coalesce('user:' || metadata.user_id, trim(string_split(repo_name || ', 10.0.0.1', ',')[1]), source_id, 'unknown') END AS client,
CASE WHEN contains(topic, 'search') THEN 50 WHEN contains(topic, 'chunks') THEN 100 WHEN contains(topic, 'sync') THEN 20 ELSE 100 END AS per_minute, count(*) AS requests
FROM (SELECT *, coalesce(metadata.retry_count, 0) > 0 AS retried FROM chunk_events) GROUP BY 1, 2""")
def pr_client_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who a request is counted for, and its limit by path; retries stand for requests without a user, repository and source for forwarded and real addresses."""
    rows = table(spark, sf_dir, "chunk_events", ["topic", "repo_name", "source_id", "metadata"])
    user = F.when(~(F.coalesce("metadata.retry_count", F.lit(0)) > 0), F.col("metadata.user_id"))
    client = contracts.client_id(user, F.concat("repo_name", F.lit(", 10.0.0.1")), F.col("source_id"))
    return rows.groupBy(client.alias("client"), contracts.requests_a_minute(F.col("topic")).alias("per_minute")).agg(F.count("*").alias("requests"))


# --- chunking ------------------------------------------------------------------------------------

_FOLD = rf"""
WITH RECURSIVE big AS (SELECT doc_id, text FROM documents WHERE strlen(text) > 1500 AND NOT (regexp_matches(text, '^[\t-\r \x{{85}}\p{{Z}}]*[\[{{]') AND json_valid(text))),
jbig AS (SELECT doc_id, CAST(text AS JSON) AS j, json_type(text) AS kind FROM documents WHERE strlen(text) > 1500 AND regexp_matches(text, '^[\t-\r \x{{85}}\p{{Z}}]*[\[{{]') AND json_valid(text)),
jpart AS (SELECT doc_id, kind, CAST(i AS BIGINT) AS i, CAST(j -> CAST(i - 1 AS INTEGER) AS VARCHAR) AS s FROM (SELECT *, unnest(range(1, CAST(json_array_length(j) AS BIGINT) + 1)) AS i FROM jbig WHERE kind = 'ARRAY')
  UNION ALL SELECT doc_id, kind, row_number() OVER (PARTITION BY doc_id ORDER BY k), CAST(to_json(k) AS VARCHAR) || ':' || CAST(json_extract(j, '$."' || k || '"') AS VARCHAR) FROM (SELECT doc_id, kind, j, unnest(json_keys(j)) AS k FROM jbig WHERE kind = 'OBJECT')),
jfold AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS i, '' AS cur, 2 AS n, CAST([] AS VARCHAR[]) AS out FROM jbig
  UNION ALL SELECT doc_id, i, CASE WHEN full_ OR cur = '' THEN s ELSE cur || ',' || s END, CASE WHEN full_ THEN 2 ELSE n END + strlen(s) + 2, CASE WHEN full_ THEN list_append(out, cur) ELSE out END
  FROM (SELECT f.doc_id, p.i, p.s, f.cur, f.n, f.out, f.cur <> '' AND f.n + strlen(p.s) + 2 > 1500 AS full_ FROM jfold f JOIN jpart p ON p.doc_id = f.doc_id AND p.i = f.i + 1)),
jdone AS (SELECT f.doc_id, CASE WHEN cur = '' THEN ['{{}}'] ELSE list_transform(list_append(out, cur), lambda c: CASE WHEN kind = 'ARRAY' THEN '[' || c || ']' ELSE '{{' || c || '}}' END) END AS out
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) AS r FROM jfold) f JOIN jbig USING (doc_id) WHERE r = 1),
para AS (SELECT doc_id, pn, p, string_split(p, '. ') AS sent FROM (
  SELECT doc_id, pn, {_trim('ps[pn]')} AS p FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS pn FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS ps FROM big))) WHERE p <> ''),
piece AS (
  SELECT doc_id, pn, 1 AS sn, p || chr(10) || chr(10) AS s FROM para WHERE strlen(p) <= 1500 OR len(sent) = 1
  UNION ALL SELECT doc_id, pn, sn, CASE WHEN sn < len(sent) THEN sent[sn] || '. ' ELSE sent[sn] END
  FROM (SELECT *, unnest(range(1, len(sent) + 1)) AS sn FROM para WHERE strlen(p) > 1500 AND len(sent) > 1)),
word AS (SELECT doc_id, pn, sn, wn, ws[wn] AS w FROM (
  SELECT *, unnest(range(1, len(ws) + 1)) AS wn FROM (SELECT doc_id, pn, sn, list_filter(regexp_split_to_array(s, '[\t-\r \x{{85}}\p{{Z}}]+'), lambda w: w <> '') AS ws FROM piece WHERE strlen(s) > 1500))),
tok AS (
  SELECT doc_id, pn, sn, 0 AS wn, 0 AS bn, s, 'p' AS k FROM piece WHERE strlen(s) <= 1500
  UNION ALL SELECT doc_id, pn, sn, 0, 0, '', 'c' FROM piece WHERE strlen(s) > 1500
  UNION ALL SELECT doc_id, pn, sn, wn, 0, w || ' ', 'p' FROM word WHERE strlen(w) <= 1500
  UNION ALL SELECT doc_id, pn, sn, wn, bn, substr(w, bn * 1500 + 1, 1500), 'h' FROM (SELECT *, unnest(range(0, CAST(ceil(length(w) / 1500.0) AS BIGINT))) AS bn FROM word WHERE strlen(w) > 1500)),
num AS (SELECT doc_id, s, k, row_number() OVER (PARTITION BY doc_id ORDER BY pn, sn, wn, bn) AS i FROM tok),
fold AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS i, '' AS cur, CAST([] AS VARCHAR[]) AS out FROM big
  UNION ALL
  SELECT doc_id, i, CASE WHEN k = 'h' THEN '' ELSE rest || s END, CASE WHEN k = 'h' THEN list_append(o2, s) ELSE o2 END FROM (
    SELECT f.doc_id, n.i, n.s, n.k, full_, CASE WHEN full_ THEN list_append(out, {_trim('cur')}) ELSE out END AS o2,
      CASE WHEN NOT full_ THEN cur WHEN strlen(cur) <= 200 THEN '' ELSE
        array_to_string(list_filter(ws, lambda w, j: list_sum(list_transform(ws[j:], lambda v: strlen(v) + 1)) <= 200), ' ') || CASE WHEN strlen(ws[-1]) < 200 THEN ' ' ELSE '' END END AS rest
    FROM (SELECT g.*, list_filter(regexp_split_to_array(cur[-400:], '[\t-\r \x{{85}}\p{{Z}}]+'), lambda w: w <> '') AS ws FROM fold g) f JOIN num n ON n.doc_id = f.doc_id AND n.i = f.i + 1,
      LATERAL (SELECT cur <> '' AND (n.k <> 'p' OR strlen(cur) + strlen(n.s) > 1500) AS full_))),
last AS (SELECT doc_id, CASE WHEN {_trim('cur')} <> '' THEN list_append(out, {_trim('cur')}) ELSE out END AS out FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) AS r FROM fold) WHERE r = 1),
whole AS (SELECT doc_id, out FROM last UNION ALL SELECT doc_id, out FROM jdone UNION ALL SELECT doc_id, [text] FROM documents WHERE strlen(text) <= 1500),
chunk AS (SELECT doc_id, CAST(o - 1 AS INTEGER) AS ordinal, out[o] AS content FROM (SELECT *, unnest(range(1, len(out) + 1)) AS o FROM whole))
"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", ["doc_id", "source", "text"])


@_query(_FOLD + "SELECT c.doc_id, ordinal, sha256(content) AS hash, CASE WHEN strpos(text, content) > 0 THEN strlen(substr(text, 1, strpos(text, content) - 1)) ELSE 0 END AS start FROM chunk c JOIN documents d ON d.doc_id = c.doc_id")
def ch_hybrid_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid chunks of all documents, with hash and first byte offset."""
    return _hybrid(_documents(spark, sf_dir))


def _hybrid(documents: DataFrame) -> DataFrame:
    rows = chunking.hybrid_chunks(documents, ["doc_id"])
    return rows.select("doc_id", "ordinal", identity.content_hash(F.col("content")).alias("hash"), "start")


@_query(_FOLD + "SELECT d.source, count(*) AS chunks, CAST(sum(strlen(content)) // count(*) AS BIGINT) AS avg_bytes FROM chunk c JOIN documents d ON d.doc_id = c.doc_id GROUP BY d.source")
def ch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks per source and their average size, in whole bytes."""
    return _stats(_documents(spark, sf_dir))


def _stats(documents: DataFrame) -> DataFrame:
    rows = chunking.hybrid_chunks(documents, ["doc_id", "source"])
    return rows.groupBy("source").agg(F.count("*").alias("chunks"), F.floor(F.sum(F.octet_length("content")) / F.count("*")).alias("avg_bytes"))


@_query("""WITH RECURSIVE b AS (SELECT batch_id, CAST('[' || string_agg(payload, ',' ORDER BY delivery_id) || ']' AS JSON) AS j, '[' || string_agg(payload, ',' ORDER BY delivery_id) || ']' AS text FROM chunk_events WHERE payload IS NOT NULL GROUP BY batch_id),
p AS (SELECT batch_id, CAST(i AS BIGINT) AS i, strlen(CAST(j -> CAST(i - 1 AS INTEGER) AS VARCHAR)) AS n FROM (SELECT *, unnest(range(1, CAST(json_array_length(j) AS BIGINT) + 1)) AS i FROM b WHERE strlen(text) > 1500)),
f AS (SELECT batch_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS items, 2 AS size, 0 AS bytes, CAST([] AS BIGINT[]) AS out FROM b WHERE strlen(text) > 1500
  UNION ALL SELECT batch_id, i, CASE WHEN full_ THEN 1 ELSE items + 1 END, CASE WHEN full_ THEN 2 ELSE size END + n + 2, CASE WHEN full_ THEN n ELSE bytes + n END, CASE WHEN full_ THEN list_append(out, bytes + items + 1) ELSE out END
  FROM (SELECT f.batch_id, p.i, p.n, f.items, f.size, f.bytes, f.out, f.items > 0 AND f.size + p.n + 2 > 1500 AS full_ FROM f JOIN p ON p.batch_id = f.batch_id AND p.i = f.i + 1)),
d AS (SELECT batch_id, list_append(out, bytes + items + 1) AS out FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY i DESC) AS r FROM f) WHERE r = 1 UNION ALL SELECT batch_id, [CAST(strlen(text) AS BIGINT)] FROM b WHERE strlen(text) <= 1500)
SELECT batch_id, CAST(o - 1 AS INTEGER) AS ordinal, CAST(out[o] AS INTEGER) AS bytes FROM (SELECT *, unnest(range(1, len(out) + 1)) AS o FROM d)""")
def ch_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON payloads of a batch as one array, packed."""
    rows = table(spark, sf_dir, "chunk_events", ["batch_id", "delivery_id", "payload"]).where("payload IS NOT NULL")
    joined = rows.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("delivery_id", "payload"))).alias("p"))
    texts = joined.select("batch_id", F.concat(F.lit("["), F.array_join("p.payload", ","), F.lit("]")).alias("text"))
    return texts.select("batch_id", F.posexplode(chunking.packed_json(F.col("text"))).alias("ordinal", "content")).select("batch_id", "ordinal", F.octet_length("content").alias("bytes"))


@_query()
def ch_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks of parsed documents: sections, tables, whole documents."""
    outputs = changes.newest(table(spark, sf_dir, "pipeline_output", ["output_id", "title", "sections", "tables"]), ["output_id"], ["title"])
    return chunking.document_chunks(outputs, ["output_id"]).select("output_id", F.col("ordinal.g").alias("part"), F.col("ordinal.place").alias("place"), F.col("ordinal.part").alias("piece"), "kind", "level", "confidence", identity.content_hash(F.col("content")).alias("hash"))


@_query(f"""
SELECT DISTINCT output_id, sha256(CASE WHEN coalesce(tables[i].caption, '') <> '' THEN 'Table: ' || tables[i].caption || chr(10) || chr(10) ELSE '' END || tables[i].markdown) AS hash
FROM (SELECT output_id, tables, unnest(range(1, len(tables) + 1)) AS i FROM pipeline_output) WHERE {_trim("coalesce(tables[i].markdown, '')")} <> ''""")
def ch_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of tables."""
    rows = chunking.document_chunks(table(spark, sf_dir, "pipeline_output", ["output_id", "title", "sections", "tables"]), ["output_id"]).where("kind = 'Table'")
    return rows.select("output_id", identity.content_hash(F.col("content")).alias("hash")).distinct()


@_query(f"""
WITH o AS (SELECT DISTINCT output_id, title, sections FROM pipeline_output WHERE len(sections) > 0),
f AS (SELECT *, list_filter(sections, lambda s: {_trim("coalesce(s.content, '')")} <> '') AS full_ FROM o)
SELECT DISTINCT output_id, sha256('# ' || coalesce(title, '') || chr(10) || chr(10) || '## Document Structure' || chr(10) ||
  array_to_string(list_transform(list_filter(sections, lambda s: coalesce(s.heading, '') <> ''), lambda s: repeat('#', coalesce(s.level, 1)) || ' ' || s.heading), chr(10)) || chr(10) || chr(10) || '---' || chr(10) || chr(10) ||
  CASE WHEN coalesce(full_[1].heading, '') <> '' THEN repeat('#', coalesce(full_[1].level, 1)) || ' ' || full_[1].heading || chr(10) || chr(10) ELSE '' END || full_[1].content) AS hash
FROM f WHERE len(full_) > 0 AND strlen(full_[1].content) <= 3000""")
def ch_first_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First section of each document, led by title and outline, where it needs no split."""
    rows = chunking.document_chunks(table(spark, sf_dir, "pipeline_output", ["output_id", "title", "sections", "tables"]), ["output_id"])
    first = rows.where((F.col("kind") == "Section") & (F.col("ordinal.place") == 0) & (F.col("confidence") == 0.95))
    return first.select("output_id", identity.content_hash(F.col("content")).alias("hash")).distinct()


@_query(rf"""
WITH l AS (SELECT doc_id, n, {_trim('lines[n]')} AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS n FROM (SELECT doc_id, regexp_split_to_array(text, '\r?\n') AS lines FROM documents WHERE text IS NOT NULL))),
k AS (SELECT *, count(*) FILTER (line LIKE '#%') OVER (PARTITION BY doc_id ORDER BY n) AS block FROM l),
b AS (SELECT doc_id, block, {_trim("string_agg(line, chr(10) || chr(10) ORDER BY n)")} AS content FROM k WHERE line NOT LIKE '#%' GROUP BY doc_id, block),
h AS (SELECT doc_id, block, {_trim("regexp_replace(line, '^#+', '')")} AS heading, least(6, length(regexp_extract(line, '^#+'))) AS level FROM k WHERE line LIKE '#%')
SELECT doc_id, coalesce(heading, '') AS heading, coalesce(level, 1) AS level, sha256(content) AS hash FROM b LEFT JOIN h USING (doc_id, block) WHERE content <> ''
UNION ALL SELECT doc_id, '', 1, sha256({_trim('text')}) FROM documents WHERE {_trim('text')} <> '' AND doc_id NOT IN (SELECT doc_id FROM b WHERE content <> '')""")
def ch_markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of the documents read as Markdown."""
    rows = parsing.markdown_sections(table(spark, sf_dir, "documents", ["doc_id", "text"]), ["doc_id"])
    return rows.select("doc_id", "heading", "level", identity.content_hash(F.col("content")).alias("hash"))


@_query(f"""
WITH t AS (SELECT DISTINCT output_id, tables FROM pipeline_output WHERE len(tables) > 0),
e AS (SELECT output_id, tables, i, coalesce(tables[i].caption, '') AS caption, regexp_split_to_array(coalesce(tables[i].markdown, ''), '\r?\n') AS raw FROM (SELECT *, unnest(range(1, len(tables) + 1)) AS i FROM t)),
k AS (SELECT *, list_position(list_transform(raw, lambda x: starts_with({_trim('x')}, '|') OR starts_with({_trim('x')}, '---') OR starts_with({_trim('x')}, 'Caption:')), false) AS bad FROM e),
r AS (SELECT *, list_filter(CASE WHEN coalesce(bad, 0) = 0 THEN raw ELSE raw[1 : bad - 1] END, lambda x: NOT starts_with({_trim('x')}, 'Caption:')) AS rows FROM k),
d AS (SELECT output_id, tables, row_number() OVER (PARTITION BY output_id, tables ORDER BY i) - 1 AS pos, {_trim('caption')} AS caption, sha256(array_to_string(rows, chr(10))) AS hash FROM r WHERE len(rows) > 0)
SELECT output_id, CAST(pos AS INTEGER) AS pos, caption, hash FROM d""")
def ch_markdown_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tables of an output announced in one text, read back in order; what is no pipe grid gives none."""
    rows = table(spark, sf_dir, "pipeline_output", ["output_id", "tables"]).where(F.size("tables") > 0)
    one = lambda t: F.concat(F.lit(f"{parsing.TABLE_MARK}\nCaption: "), F.coalesce(t["caption"], F.lit("")), F.lit("\n"), F.coalesce(t["markdown"], F.lit("")))
    texts = rows.select("output_id", F.concat(F.lit("before\n"), F.array_join(F.transform("tables", one), "\nbetween\n"), F.lit("\nafter")).alias("text"))
    texts = texts.where("text IS NOT NULL").distinct().withColumn("version", F.xxhash64("text"))
    found = parsing.markdown_tables(texts, ["output_id", "version"])
    return found.select("output_id", "pos", "caption", identity.content_hash(F.col("markdown")).alias("hash"))


# --- identity ------------------------------------------------------------------------------------


def _uuid5_sql(space: str, name: str) -> str:
    h = f"sha1(unhex(replace({space}, '-', '')) || encode({name}))"
    return f"(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) FROM (SELECT {h} AS h))"


@_query(f"SELECT chunk_id, sha256(content) AS chunk_hash, {_uuid5_sql(_uuid5_sql(chr(39) + T.NAMESPACE_URL + chr(39), 'source_id || chr(124) || filename'), 'start_line || chr(45) || end_line')} AS span_id, {_uuid5_sql(_uuid5_sql(chr(39) + T.NAMESPACE_URL + chr(39), 'source_id || chr(124) || filename'), 'chunk_id || chr(124) || sha256(content)')} AS stable_id FROM {_CHUNKS} WHERE content IS NOT NULL")
def id_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content hash, span id and signature id of every chunk."""
    s, f, c = F.col("source_id"), F.col("filename"), F.col("content")
    rows = _chunks(spark, sf_dir, "content", "start_line", "end_line").where("content IS NOT NULL")
    return rows.select("chunk_id", identity.content_hash(c).alias("chunk_hash"), identity.span_id(s, f, F.col("start_line"), F.col("end_line")).alias("span_id"), identity.signature_id(s, f, F.col("chunk_id"), c).alias("stable_id"))


_NEXT = f"""
SELECT * FROM (SELECT chunk_id AS src, lead(chunk_id) OVER (PARTITION BY source_id, filename ORDER BY start_line, chunk_id) AS dst FROM (SELECT DISTINCT chunk_id, source_id, filename, start_line FROM chunk_data)) WHERE dst IS NOT NULL AND src <> dst"""


@_query(f"SELECT src, dst, {_uuid5_sql(_uuid5_sql(chr(39) + T.NAMESPACE_OID + chr(39), chr(39) + 'chunk_relationship' + chr(39)), 'src || chr(95) || dst || chr(95) || ' + chr(39) + 'NextChunk' + chr(39))} AS edge_id FROM ({_NEXT})")
def rx_next_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading order with deterministic edge ids."""
    rows = graph.next_chunk(_chunks(spark, sf_dir, "start_line"), ["source_id", "filename"], ["start_line", "chunk_id"], "chunk_id")
    return rows.withColumn("edge_id", identity.edge_id(F.col("src"), F.col("dst"), F.lit("NextChunk")))


@_query("""
SELECT first AS src, chunk_id AS dst FROM (SELECT chunk_id, first_value(chunk_id) OVER (PARTITION BY source_id, filename ORDER BY start_line, chunk_id) AS first
FROM (SELECT DISTINCT chunk_id, source_id, filename, start_line FROM chunk_data WHERE start_line IS NOT NULL)) WHERE first <> chunk_id""")
def rx_parent_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First chunk of each file to its others."""
    return graph.parent_of(_chunks(spark, sf_dir, "start_line").where("start_line IS NOT NULL"), ["source_id", "filename"], ["start_line"], "chunk_id").select("src", "dst")


# --- relations -----------------------------------------------------------------------------------

_LINKED = """
SELECT d.doc_id, d.path, d.text || chr(10) || 'see [next](' || n.path || ') and [site](https://x.example) @cite{k' || d.doc_id || '}' || chr(10) || '```text ' || n.path || chr(10) || '```' AS content
FROM documents d JOIN documents n ON n.doc_id = d.doc_id + 1 WHERE d.text IS NOT NULL AND n.path IS NOT NULL"""


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "path", "text"])
    after = docs.where("path IS NOT NULL").select((F.col("doc_id") - 1).alias("doc_id"), F.col("path").alias("next"))
    more = F.concat(F.col("text"), F.lit("\nsee [next]("), F.col("next"), F.lit(") and [site](https://x.example) @cite{k"), F.col("doc_id"), F.lit("}\n```text "), F.col("next"), F.lit("\n```"))
    return docs.join(after, "doc_id").where("text IS NOT NULL").select("doc_id", "path", more.alias("content"))


_LINES = rf"l AS (SELECT doc_id, path, n AS line_no, lines[n] AS line FROM (SELECT doc_id, path, lines, unnest(range(1, len(lines) + 1)) AS n FROM (SELECT doc_id, path, regexp_split_to_array(content, '\r?\n') AS lines FROM ({_LINKED}))))"
_TARGETS = "t AS (SELECT path, max(doc_id) AS target_doc FROM documents WHERE path IS NOT NULL GROUP BY path)"


@_query(rf"""WITH {_LINES}, {_TARGETS},
m AS (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '\[[^\]]+\]\(([^)]+)\)', 1)) AS target FROM l WHERE contains(line, ']('))
SELECT DISTINCT doc_id, CAST(line_no AS INTEGER) AS line_no, target_doc, CAST(0.9 AS DOUBLE) AS confidence FROM m JOIN t ON t.path = m.target WHERE target NOT LIKE 'http%' AND target_doc <> doc_id""")
def rx_md_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown links resolved to documents; the last document of a path is its target."""
    found = graph.markdown_links(graph.lines(_linked(spark, sf_dir), ["doc_id"]), ["doc_id"]).where(~F.col("target").startswith("http"))
    paths = table(spark, sf_dir, "documents", ["doc_id", "path"]).where("path IS NOT NULL").groupBy(F.col("path").alias("target")).agg(F.max("doc_id").alias("target_doc"))
    return found.join(paths, "target").where("target_doc <> doc_id").select("doc_id", "line_no", "target_doc", F.lit(0.9).alias("confidence")).distinct()


@_query(rf"WITH {_LINES} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, unnest(list_concat(regexp_extract_all(line, '@cite\{{([^}}]+)\}}', 1), regexp_extract_all(line, '\[@([^\]]+)\]', 1))) AS key FROM l")
def rx_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation keys by line."""
    return graph.citations(graph.lines(_linked(spark, sf_dir), ["doc_id"]), ["doc_id"])


@_query(rf"""WITH {_LINES}, {_TARGETS}, m AS (SELECT doc_id, line_no, regexp_extract(line, '```\w+\s+([^\s`]+)', 1) AS f FROM l WHERE contains(line, '```'))
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, target_doc FROM m JOIN t ON t.path = m.f WHERE target_doc <> doc_id""")
def rx_code_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files named by code fences."""
    found = graph.fence_files(graph.lines(_linked(spark, sf_dir), ["doc_id"]), ["doc_id"])
    paths = table(spark, sf_dir, "documents", ["doc_id", "path"]).where("path IS NOT NULL").groupBy(F.col("path").alias("filename")).agg(F.max("doc_id").alias("target_doc"))
    return found.join(paths, "filename").where("target_doc <> doc_id").select("doc_id", "line_no", "target_doc")


# The extensions of a language, its link types and their patterns as the SQL check has them.
_REFERENCE_SQL = """
html htm|html_css_link|href=["']([^"']+\\.css)["']
html htm|html_script_link|<script[^>]+src=["']([^"']+)["']
html htm|html_img_link|<img[^>]+src=["']([^"']+)["']
html htm|html_link_tag|<link[^>]+href=["']([^"']+)["']
css scss less|css_import|@import\\s+url\\(["']?([^"'()]+)["']?\\)
css scss less|css_import|@import\\s+["']([^"']+)["']
js jsx mjs cjs ts tsx mts cts|js_import|import\\s+.*?from\\s+["']([^"']+)["']
js jsx mjs cjs ts tsx mts cts|js_require|require\\s*\\(\\s*["']([^"']+)["']\\s*\\)
js jsx mjs cjs ts tsx mts cts|js_dynamic_import|import\\s*\\(\\s*["']([^"']+)["']\\s*\\)
py|python_from_import|from\\s+(\\S+)\\s+import
py|python_import|import\\s+(\\S+)
rs|rust_mod|mod\\s+(\\w+)\\s*;
rs|rust_use|use\\s+(?:crate::)?(\\w+)
go|go_import|import\\s+"([^"]+)"
java|java_import|import\\s+([a-zA-Z_][\\w.]*)
cs|csharp_using|using\\s+([a-zA-Z_][\\w.]*)\\s*;
c h hpp hxx cpp cc cxx|c_include|#include\\s+"([^"]+)"
rb|ruby_require|require\\s+["']([^"']+)["']
rb|ruby_require_relative|require_relative\\s+["']([^"']+)["']
php|php_require|(?:require|include)(?:_once)?\\s+["']([^"']+)["']
swift|swift_import|import\\s+(\\w+)
kt kts|kotlin_import|import\\s+([a-zA-Z_][\\w.]*)
scala sc|scala_import|import\\s+([a-zA-Z_][\\w.]*)
sh bash zsh|bash_source|source\\s+["']?([^"'\\s]+)["']?
sh bash zsh|bash_dot_source|\\.\\s+["']?([^"'\\s]+)["']?
md markdown|markdown_link|\\[[^\\]]*\\]\\(([^)]+)\\)
"""


def _refs_sql(chunks: str = _CHUNKS, ext: str = _EXT, keep: str = "chunk_id, source_id") -> str:
    parts = []
    for line in _REFERENCE_SQL.strip().split("\n"):
        extensions, kind, pattern = line.split("|", 2)
        known = ", ".join(f"'{e}'" for e in extensions.split())
        parts.append(f"SELECT {keep}, '{kind}' AS link_type, unnest(regexp_extract_all(content, '{pattern.replace(chr(39), chr(39) * 2)}', 1)) AS target FROM c WHERE ext IN ({known})")
    name = "regexp_replace(regexp_replace(target, '^(\\./)+', ''), '^(\\.\\./)+', '')"
    return f"c AS (SELECT *, {ext} AS ext FROM {chunks}), m AS ({' UNION ALL '.join(parts)}), r AS (SELECT *, regexp_replace(regexp_extract({name}, '[^/]*$'), '(.)\\.[^.]*$', '\\1') AS name FROM m)"


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chunks(spark, sf_dir, "content").withColumn("language", N.language(F.col("filename")))
    return graph.references(rows, ["chunk_id", "source_id"])


# A file of each language that names another one in every way the language has; # stands for the name.
_REFERRING = """
html|<link rel="x" href="./#.css"> <script async src='../#.js'> <img alt=a src="#.png">
css|@import url(#.css); @import url("../#.css"); @import '#.less';
js|import { a } from './#'; const b = require ( "../#.js" ); import( '#' )
tsx|import a, { b } from "#"; require("#.json")
py|from .# import a as b; import #.c
rs|mod # ; use crate::#::x; use #;
go|import "#/x"
java|import static_.#.Name;
cs|using System.# ;
c|#include <stdio.h> #include "#.h"
cpp|#include  "../#.hpp"
rb|require '#' ; require_relative "./#"
php|require_once '#.php'; include "#.inc"; include('no')
swift|import #
kt|import a.#.*
scala|import a.#._
sh|source "#.sh"; . ./#.env
md|see [that](../#.md) and [](#)
"""


@_query(f"""WITH p AS (SELECT unnest(string_split('{_REFERRING.strip().replace(chr(39), chr(39) * 2)}', chr(10))) AS line),
d AS (SELECT doc_id, kind FROM documents WHERE regexp_matches(kind, '^[a-z]+$')),
planted AS (SELECT doc_id, split_part(line, '|', 1) AS language, replace(substr(line, strpos(line, '|') + 1), '#', kind) AS text FROM p, d),
given AS (SELECT doc_id, language AS ext_, replace(text, kind_ || 'include', '#include') AS content FROM (SELECT *, (SELECT kind FROM d WHERE d.doc_id = planted.doc_id) AS kind_ FROM planted)),
{_refs_sql("given", "ext_", "doc_id, ext_")} SELECT doc_id, ext_ AS language, link_type, target, name, count(*) AS n FROM r WHERE name <> '' GROUP BY ALL""")
def rx_planted_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References in files of every language that name the kind of a document."""
    planted = [tuple(x.split("|", 1)) for x in _REFERRING.strip().split("\n")]
    docs = table(spark, sf_dir, "documents", ["doc_id", "kind"]).where(F.col("kind").rlike("^[a-z]+$"))
    files = F.array(*[F.struct(F.lit(a).alias("extension"), F.lit(b).alias("text")) for a, b in planted])
    rows = docs.select("doc_id", "kind", F.explode(files).alias("f"))
    text = F.replace(F.replace("f.text", F.lit("#"), F.col("kind")), F.concat(F.col("kind"), F.lit("include")), F.lit("#include"))
    rows = rows.select("doc_id", F.col("f.extension").alias("extension"), text.alias("content")).withColumn("language", N.language(F.concat(F.lit("f."), F.col("extension"))))
    found = graph.references(rows, ["doc_id", "extension"])
    return found.groupBy("doc_id", F.col("extension").alias("language"), "link_type", "target", "name").agg(F.count("*").alias("n"))


@_query(f"WITH {_refs_sql()} SELECT link_type, name, count(*) AS n FROM r WHERE name <> '' GROUP BY ALL")
def rx_import_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports and links of source code by type and bare name."""
    return _references(spark, sf_dir).groupBy("link_type", "name").agg(F.count("*").alias("n"))


@_query(f"""WITH {_refs_sql()}, f AS (SELECT DISTINCT source_id, filename, regexp_replace({_BASE}, '(.)\\.[^.]*$', '\\1') AS name FROM chunk_data)
SELECT DISTINCT r.chunk_id, r.link_type, f.filename AS target FROM r JOIN f ON f.source_id = r.source_id AND f.name = r.name WHERE r.name <> ''""")
def rx_forward_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to files of the same source, joined on the extracted stem."""
    files = table(spark, sf_dir, "chunk_data", ["source_id", "filename"]).distinct().withColumn("name", N.stem(F.col("filename")))
    return _references(spark, sf_dir).join(files, ["source_id", "name"]).select("chunk_id", "link_type", F.col("filename").alias("target")).distinct()


@_query(f"""WITH f AS (SELECT DISTINCT source_id, filename, regexp_replace({_BASE}, '(.)\\.[^.]*$', '\\1') AS name FROM chunk_data)
SELECT DISTINCT c.chunk_id, f.filename AS target FROM {_CHUNKS} c JOIN f ON f.source_id = c.source_id AND contains(c.content, f.name) WHERE f.filename <> c.filename AND f.name <> ''""")
def rx_reverse_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that contain the stem of another file of their source, wherever it stands."""
    files = table(spark, sf_dir, "chunk_data", ["source_id", "filename"]).distinct().select("source_id", F.col("filename").alias("target"), N.stem(F.col("filename")).alias("name"))
    return graph.containing(table(spark, sf_dir, "chunk_data", ["chunk_id", "source_id", "filename", "content"]), files)


@_query(f"""WITH p AS (SELECT chunk_id AS src, dst, 'NEXT_CHUNK' AS type FROM (SELECT chunk_id, lead(chunk_id) OVER (PARTITION BY source_id, filename ORDER BY start_line, chunk_id) AS dst FROM (SELECT DISTINCT chunk_id, source_id, filename, start_line FROM chunk_data WHERE start_line IS NOT NULL)) WHERE dst IS NOT NULL AND dst <> chunk_id
UNION SELECT first, chunk_id, 'PARENT_OF' FROM (SELECT chunk_id, first_value(chunk_id) OVER (PARTITION BY source_id, filename ORDER BY start_line, chunk_id) AS first FROM (SELECT DISTINCT chunk_id, source_id, filename, start_line FROM chunk_data WHERE start_line IS NOT NULL)) WHERE first <> chunk_id)
SELECT c.source_id, type, count(*) AS edges FROM p JOIN (SELECT DISTINCT chunk_id, source_id FROM chunk_data) c ON c.chunk_id = p.src GROUP BY ALL""")
def rx_graph_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that a sync of every source writes, by type."""
    chunks = _chunks(spark, sf_dir, "start_line").where("start_line IS NOT NULL")
    edges = graph.graph_sync(chunks, ["source_id", "filename"], ["start_line"], "chunk_id")
    return edges.join(chunks.select(F.col("chunk_id").alias("src"), "source_id").distinct(), "src").groupBy("source_id", "type").agg(F.count("*").alias("edges"))


@_query("""WITH p AS (SELECT DISTINCT path AS url, 'page' AS kind FROM documents WHERE path IS NOT NULL), l AS (SELECT DISTINCT a.path AS src, b.path AS dst FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.path IS NOT NULL AND b.path IS NOT NULL AND a.path IN (SELECT url FROM p))
SELECT url, any_value(kind) AS kind, count(dst) AS links FROM (SELECT url, kind FROM p UNION ALL SELECT DISTINCT dst, NULL FROM l WHERE dst NOT IN (SELECT url FROM p)) LEFT JOIN l ON src = url GROUP BY url""")
def gr_web_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of all documents and the links between them."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "path"])
    return _web_links(docs, docs)


def _web_links(docs: DataFrame, known: DataFrame) -> DataFrame:
    pages = known.where("path IS NOT NULL").select(F.col("path").alias("url"), F.lit("page").alias("kind")).distinct()
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("path").alias("dst"))
    links = docs.join(after, "doc_id").where("path IS NOT NULL AND dst IS NOT NULL").select(F.col("path").alias("src"), "dst")
    every, kept = graph.linked_pages(pages, links)
    counts = kept.groupBy(F.col("src").alias("url")).agg(F.count("*").alias("links"))
    return every.join(counts, "url", "left").select("url", "kind", F.coalesce("links", F.lit(0)).alias("links"))


# --- changes and tables --------------------------------------------------------------------------

_V = """v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_key ORDER BY last_indexed_at DESC) AS rn FROM (SELECT DISTINCT source_id, filename, chunk_key, chunk_hash, tombstone, last_indexed_at FROM chunk_snapshot {0})) WHERE rn = 1)"""
_SPLIT = "TIMESTAMP '2025-04-19 03:00:00'"


def _versions(spark: SparkSession, sf_dir: str, before: str | None = None) -> DataFrame:
    rows = table(spark, sf_dir, "chunk_snapshot", ["source_id", "filename", "chunk_key", "chunk_hash", "tombstone", "last_indexed_at"])
    rows = rows.where(F.col("last_indexed_at") < F.lit(before).cast("timestamp_ntz")) if before else rows
    return changes.newest(rows, ["chunk_key"], ["last_indexed_at"])


_BEFORE = "2025-04-19 03:00:00"


@_query(f"""WITH a AS (WITH {_V.format("WHERE last_indexed_at < " + _SPLIT)} SELECT * FROM v), b AS (WITH {_V.format("")} SELECT * FROM v WHERE NOT tombstone)
SELECT coalesce(a.chunk_key, b.chunk_key) AS chunk_key, CASE WHEN a.chunk_key IS NULL THEN 'added' WHEN b.chunk_key IS NULL THEN 'removed' WHEN lower(a.chunk_hash) = lower(b.chunk_hash) THEN 'clean' ELSE 'dirty' END AS state
FROM a FULL JOIN b ON a.chunk_key = b.chunk_key""")
def df_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of an earlier state against the present ones, by key."""
    return changes.diff_by_key(_versions(spark, sf_dir, _BEFORE), _versions(spark, sf_dir).where("NOT tombstone"))


@_query(f"""WITH a AS (WITH {_V.format("WHERE last_indexed_at < " + _SPLIT)} SELECT *, row_number() OVER (PARTITION BY source_id, filename, lower(chunk_hash) ORDER BY chunk_key) AS n FROM v WHERE NOT tombstone),
b AS (WITH {_V.format("")} SELECT *, row_number() OVER (PARTITION BY source_id, filename, lower(chunk_hash) ORDER BY chunk_key) AS n FROM v WHERE NOT tombstone)
SELECT CASE WHEN a.chunk_key IS NULL THEN 'new' WHEN b.chunk_key IS NULL THEN 'deleted' ELSE 'unchanged' END AS state, coalesce(a.source_id, b.source_id) AS source_id, count(*) AS chunks
FROM a FULL JOIN b ON a.source_id = b.source_id AND a.filename = b.filename AND lower(a.chunk_hash) = lower(b.chunk_hash) AND a.n = b.n GROUP BY ALL""")
def df_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by content hash, counted by source."""
    return changes.diff_by_hash(_versions(spark, sf_dir, _BEFORE), _versions(spark, sf_dir).where("NOT tombstone")).groupBy("state", "source_id").agg(F.count("*").alias("chunks"))


@_query(f"""WITH a AS (WITH {_V.format("WHERE last_indexed_at < " + _SPLIT)} SELECT * FROM v), b AS (WITH {_V.format("")} SELECT * FROM v WHERE NOT tombstone)
SELECT coalesce(b.chunk_key, a.chunk_key) AS chunk_key, coalesce(b.chunk_hash, a.chunk_hash) AS chunk_hash, b.chunk_key IS NULL AS tombstone FROM a FULL JOIN b ON a.chunk_key = b.chunk_key""")
def df_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored table after tombstoning what is gone and upserting what is there."""
    columns = ["chunk_key", "chunk_hash", "tombstone"]
    stored, new = _versions(spark, sf_dir, _BEFORE).select(*columns), _versions(spark, sf_dir).where("NOT tombstone").select(*columns)
    gone = stored.select("chunk_key").join(new.select("chunk_key"), "chunk_key", "left_anti")
    return changes.replaced(stored, new, gone, "chunk_key")


_REPORTS = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, filename ORDER BY processed_at DESC, id DESC, user_id DESC) AS rn FROM (SELECT DISTINCT id, source_id, user_id, filename, size_bytes, processed_at FROM file_metadata) WHERE processed_at {0} TIMESTAMP '2025-07-01') WHERE rn = 1)"


@_query(f"""SELECT coalesce(a.id, b.id) AS id, coalesce(a.source_id, b.source_id) AS source_id, coalesce(a.filename, b.filename) AS filename, CASE WHEN a.filename IS NULL THEN b.user_id ELSE a.user_id END AS user_id,
  CASE WHEN b.filename IS NULL THEN a.size_bytes ELSE b.size_bytes END AS size_bytes FROM {_REPORTS.format("<")} a FULL JOIN {_REPORTS.format(">=")} b ON a.source_id = b.source_id AND a.filename = b.filename""")
def up_file_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later reports of a file merged into earlier ones; id and user stay."""
    rows = table(spark, sf_dir, "file_metadata", ["id", "source_id", "user_id", "filename", "size_bytes", "processed_at"])
    when = F.lit("2025-07-01").cast("timestamp_ntz")
    pick = lambda df: changes.newest(df, ["source_id", "filename"], ["processed_at", "id", "user_id"])
    merged = changes.upsert(pick(rows.where(F.col("processed_at") < when)), pick(rows.where(F.col("processed_at") >= when)), ["source_id", "filename"], kept=["id", "user_id"])
    return merged.select("id", "source_id", "filename", "user_id", "size_bytes")


@_query("""SELECT CAST(run_id AS VARCHAR) AS job, CASE status WHEN 'succeeded' THEN 'completed' WHEN 'running' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'succeeded' THEN finished_at END AS completed_at FROM index_runs""")
def up_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs as created, after their updates."""
    runs = table(spark, sf_dir, "index_runs")
    stored = runs.select(F.col("run_id").cast("string").alias("job"), F.lit("pending").alias("status"), F.lit(None).cast("timestamp_ntz").alias("completed_at"))
    ended = runs.where("status <> 'running'").select(
        F.col("run_id").cast("string").alias("job"), F.when(F.col("status") == "succeeded", "completed").otherwise(F.col("status")).alias("status"), F.when(F.col("status") == "succeeded", F.col("finished_at")).cast("timestamp_ntz").alias("completed_at")
    )
    return changes.upsert(stored, ended, ["job"])


@_query("""SELECT name, removed, CAST(total - removed AS BIGINT) AS kept FROM (SELECT 'file_metadata' AS name, count(*) AS total, count(*) FILTER (source_id = 'atlas-monorepo') AS removed FROM file_metadata
UNION ALL SELECT 'chunk_snapshot', count(*), count(*) FILTER (source_id = 'atlas-monorepo') FROM chunk_snapshot UNION ALL SELECT 'chunk_data', count(*), count(*) FILTER (source_id = 'atlas-monorepo') FROM chunk_data)""")
def up_delete_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source deleted from three tables: what went from each, and what is left."""
    left, removed = store.delete_source({n: table(spark, sf_dir, n) for n in ("file_metadata", "chunk_snapshot", "chunk_data")}, "atlas-monorepo")
    kept = None
    for name, rows in left.items():
        one = rows.agg(F.lit(name).alias("name"), F.count("*").alias("kept"))
        kept = one if kept is None else kept.unionByName(one)
    return removed.join(kept, "name")


@_query("SELECT vec_id AS id, label, CASE WHEN vec_id % 5 = 0 THEN NULL ELSE 64 END AS dimension FROM embeddings")
def ev_apply_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding messages applied to the nodes they name; unknown nodes and empty vectors change nothing."""
    rows = table(spark, sf_dir, "embeddings")
    nodes = rows.select(F.col("vec_id").cast("string").alias("id"), "label", F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("string").alias("model"))
    vector = F.when(F.col("vec_id") % 5 == 0, F.array().cast("array<float>")).otherwise(F.col("embedding"))
    chunk = F.struct(F.col("vec_id").cast("string").alias("id"), vector.alias("embedding"), F.lit("m").alias("model"), F.lit(64).alias("dimension"))
    lost = F.struct(F.lit("absent").alias("id"), F.col("embedding").alias("embedding"), F.lit("m").alias("model"), F.lit(64).alias("dimension"))
    messages = rows.select(F.to_json(F.struct(F.struct(F.col("vec_id").cast("string").alias("event_id")).alias("headers"), F.lit("s").alias("source_id"), F.array(chunk, lost).alias("chunks"))).alias("value"))
    done = events.with_embeddings(nodes, events.embedding_rows(messages))
    return done.select(F.col("id").cast("bigint").alias("id"), "label", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dimension"))


# --- graph ---------------------------------------------------------------------------------------


@_query(f"""WITH e AS ({_NEXT}), n AS (SELECT DISTINCT source_id, chunk_id FROM chunk_data)
SELECT source_id, count(DISTINCT n.chunk_id) AS chunk_count, count(e.dst) AS relationship_count FROM n LEFT JOIN e ON e.src = n.chunk_id GROUP BY source_id""")
def gr_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and relations of each source."""
    chunks = _chunks(spark, sf_dir, "start_line")
    edges = graph.next_chunk(chunks, ["source_id", "filename"], ["start_line", "chunk_id"], "chunk_id")
    return graph.graph_stats(chunks, edges, key="chunk_id")


@_query("""WITH e AS (SELECT delivery_id, metadata.user_id AS src, source_id AS dst, CAST(coalesce(metadata.retry_count, 0) AS DOUBLE) AS confidence, topic AS metadata, received_at AS created_at FROM chunk_events WHERE metadata.user_id IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY delivery_id % 2 DESC, delivery_id DESC) AS n FROM e)
SELECT src, dst, 'READS' AS type, confidence, metadata, created_at FROM r WHERE n = 1""")
def gr_edge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges written in two runs, the second into the edges of the first: all properties are those of the last writer."""
    rows = table(spark, sf_dir, "chunk_events", ["delivery_id", "source_id", "metadata", "topic", "received_at"]).where("metadata.user_id IS NOT NULL")
    edges = rows.select(F.col("metadata.user_id").alias("src"), F.col("source_id").alias("dst"), F.lit("READS").alias("type"), F.coalesce("metadata.retry_count", F.lit(0)).cast("double").alias("confidence"), F.col("topic").alias("metadata"), F.col("received_at").alias("created_at"), "delivery_id")
    empty = edges.drop("delivery_id").where(F.lit(False))
    late = F.col("delivery_id") % 2 == 1
    first = store.merge_edges(empty, edges.where(~late), "delivery_id")
    return store.merge_edges(first, edges.where(late), "delivery_id")


@_query("""WITH f AS (SELECT source_id || '::' || filename AS qn, min(filename) AS name, min(source_id) AS source_id FROM file_metadata WHERE source_id IS NOT NULL AND filename IS NOT NULL GROUP BY 1),
c AS (SELECT source_id || '::' || filename AS qn, chunk_id, source_id, start_line, chunk_type, row_number() OVER (PARTITION BY source_id, filename ORDER BY coalesce(start_line, -1) DESC, chunk_id DESC) AS n FROM (SELECT DISTINCT chunk_id, source_id, filename, start_line, chunk_type FROM chunk_data))
SELECT coalesce(c.qn, f.qn) AS qualified_name, coalesce(c.chunk_id, 'file') AS id, CASE WHEN c.qn IS NULL THEN 'private' WHEN c.start_line > 1 THEN 'internal' ELSE 'public' END AS visibility, CASE WHEN c.qn IS NULL THEN 'x' ELSE '' END AS signature,
f.qn IS NOT NULL AS stored, c.qn IS NOT NULL AS written FROM f FULL JOIN (SELECT * FROM c WHERE n = 1) c ON c.qn = f.qn""")
def gr_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of files stored first, then written again by their chunks: the last chunk holds, who was there keeps its creation."""
    name = F.concat_ws("::", "source_id", "filename").alias("qualified_name")
    files = _files(spark, sf_dir).where("source_id IS NOT NULL AND filename IS NOT NULL").select(name, F.lit("file").alias("id"), F.lit("x").alias("signature"), F.lit("private").alias("visibility"))
    none = files.select("*", F.lit(None).cast("int").alias("created_at"), F.lit(None).cast("int").alias("updated_at")).where(F.lit(False))
    stored = store.merge_nodes(none, store.entities(files), "qualified_name", F.lit(1))
    rows = _chunks(spark, sf_dir, "start_line").select(name, F.col("chunk_id").alias("id"), F.lit(None).cast("string").alias("signature"), F.when(F.col("start_line") > 1, "internal").alias("visibility"), F.coalesce("start_line", F.lit(-1)).alias("line"))
    merged = store.merge_nodes(stored, store.entities(rows), "qualified_name", F.lit(2), ["line", "id"])
    return merged.select("qualified_name", "id", "visibility", "signature", (F.col("created_at") == 1).alias("stored"), (F.col("updated_at") == 2).alias("written"))


@_query("""WITH r AS (SELECT source_id, count(*) AS files FROM (SELECT DISTINCT source_id, filename FROM file_metadata) GROUP BY source_id HAVING count(*) > 5),
e AS (SELECT DISTINCT source_id || '::' || filename AS qn FROM file_metadata WHERE source_id IS NOT NULL AND filename IS NOT NULL),
w AS (SELECT DISTINCT source_id || '::' || filename AS src, source_id AS dst FROM chunk_data UNION SELECT DISTINCT source_id || '::' || filename || '.lost', source_id FROM chunk_data)
SELECT dst AS repository, count(*) AS entities FROM w WHERE src IN (SELECT qn FROM e) AND dst IN (SELECT source_id FROM r) GROUP BY dst""")
def gr_belongs_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities linked to their repository: links to one that isn't there, here those of few files, or from an unknown entity aren't made."""
    files = _files(spark, sf_dir).where("source_id IS NOT NULL AND filename IS NOT NULL")
    known = files.select(F.concat_ws("::", "source_id", "filename").alias("qualified_name"))
    repositories = files.groupBy("source_id").agg(F.count("*").alias("files")).where("files > 5")
    path = F.concat_ws("::", "source_id", "filename")
    links = _chunks(spark, sf_dir).select(F.explode(F.array(path, F.concat(path, F.lit(".lost")))).alias("src"), F.col("source_id").alias("dst")).distinct()
    return store.matched(links, known, repositories, "qualified_name", "source_id").groupBy(F.col("dst").alias("repository")).agg(F.count("*").alias("entities"))


@_query(f"""WITH e AS ({_NEXT}), n AS (SELECT chunk_id, min(source_id || '|' || chunk_id || '|' || filename) AS name FROM chunk_data WHERE start_line > 1 GROUP BY chunk_id)
SELECT a.name AS src, b.name AS dst FROM e JOIN n a ON a.chunk_id = e.src JOIN n b ON b.chunk_id = e.dst""")
def gr_sync_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading order between composite ids: ends are looked up, edges with an end that has none, here a first chunk, are dropped."""
    chunks = _chunks(spark, sf_dir, "start_line")
    edges = graph.next_chunk(chunks, ["source_id", "filename"], ["start_line", "chunk_id"], "chunk_id")
    names = chunks.where("start_line > 1").select("chunk_id", N.composite_id(F.col("source_id"), F.col("chunk_id"), F.col("filename")).alias("name"))
    return store.resolved(edges, names, "chunk_id", "name").select("src", "dst")


_ENTITY_EDGES = """e AS (SELECT DISTINCT source_id || '::' || filename AS qn FROM file_metadata WHERE source_id IS NOT NULL AND filename IS NOT NULL)"""


@_query(f"""WITH {_refs_sql()}, {_ENTITY_EDGES}, f AS (SELECT DISTINCT source_id, filename, regexp_replace({_BASE}, '(.)\\.[^.]*$', '\\1') AS name FROM chunk_data),
w AS (SELECT DISTINCT c.source_id || '::' || c.filename AS src, f.source_id || '::' || f.filename AS dst, r.link_type FROM r JOIN (SELECT DISTINCT chunk_id, source_id, filename FROM chunk_data) c ON c.chunk_id = r.chunk_id JOIN f ON f.source_id = r.source_id AND f.name = r.name WHERE r.name <> '')
SELECT src, dst, 'IMPORTS' AS type, max(link_type) AS detection_method FROM w WHERE src IN (SELECT qn FROM e) AND dst IN (SELECT qn FROM e) GROUP BY src, dst""")
def gr_entity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References between files as edges of their entities, written only between entities that exist; the greatest method stands for the last writer."""
    known = _files(spark, sf_dir).where("source_id IS NOT NULL AND filename IS NOT NULL").select(F.concat_ws("::", "source_id", "filename").alias("qn"))
    rows = _chunks(spark, sf_dir, "content").withColumn("language", N.language(F.col("filename")))
    found = graph.references(rows, ["chunk_id", "source_id", "filename"])
    files = _chunks(spark, sf_dir).select("source_id", F.col("filename").alias("file"), N.stem(F.col("filename")).alias("name")).distinct()
    edges = found.join(files, ["source_id", "name"]).select(F.concat_ws("::", "source_id", "filename").alias("src"), F.concat_ws("::", "source_id", "file").alias("dst"), F.lit("IMPORTS").alias("type"), F.col("link_type").alias("detection_method"))
    edges = store.matched(edges, known, known, "qn", "qn").withColumn("at", F.col("detection_method"))
    return store.merge_edges(edges.drop("at").where(F.lit(False)), edges, "at")


_NODE_NAMES = r"""p AS (SELECT id, source_id, string_split(id, '|') AS parts FROM n),
q AS (SELECT id, source_id, k, len(parts) AS of, string_split(parts[k], '/') AS steps FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS k FROM p)),
t AS (SELECT id, source_id, k, of, i, len(steps) AS many, steps[i] AS step, string_split(steps[i], '.') AS dots FROM (SELECT *, unnest(range(1, len(steps) + 1)) AS i FROM q)),
names AS (SELECT DISTINCT id, source_id, array_to_string(dots[1 : d], '.') AS name FROM (SELECT *, unnest(range(1, len(dots))) AS d FROM t WHERE NOT (k = 1 AND i = 1))
  UNION SELECT DISTINCT id, source_id, step FROM t WHERE NOT (k = 1 AND i = 1) AND i = many AND k < of)"""


@_query(f"""WITH {_refs_sql("(SELECT DISTINCT source_id, filename, content, source_id || chr(124) || filename || chr(124) || chunk_id AS id FROM chunk_data)", _EXT, "id, source_id")}, n AS (SELECT DISTINCT source_id || '|' || filename || '|' || chunk_id AS id, source_id FROM chunk_data), {_NODE_NAMES},
o AS (SELECT id, source_id, filename, lead(id) OVER (PARTITION BY source_id, filename ORDER BY id) AS following FROM (SELECT DISTINCT source_id || '|' || filename || '|' || chunk_id AS id, source_id, filename FROM chunk_data)),
e AS (SELECT id AS src, following AS dst, 'NEXT_CHUNK' AS type, '' AS link_type FROM o WHERE following IS NOT NULL
  UNION SELECT source_id || '|' || filename || '|' || max(chunk_id), source_id || '|' || filename || '|next', 'NEXT_CHUNK', '' FROM chunk_data GROUP BY source_id, filename
  UNION SELECT r.id, names.id, 'LINKS_TO', r.link_type FROM r JOIN names ON names.source_id = r.source_id AND names.name = r.name WHERE r.name <> '' AND r.id <> names.id)
SELECT src, dst, type, link_type FROM e""")
def gr_consume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges after embedding messages of all files, each ending in a chunk nobody stored: reading order within a message, and links to files referred to."""
    rows = _chunks(spark, sf_dir, "content").withColumn("id", N.composite_id(F.col("source_id"), F.col("filename"), F.col("chunk_id")))
    nodes = rows.select("id", "source_id", N.language(F.col("filename")).alias("language"), "content", F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("string").alias("model"))
    ids = F.concat(F.sort_array(F.collect_set("id")), F.array(N.composite_id(F.col("source_id"), F.col("filename"), F.lit("next"))))
    files = rows.groupBy("source_id", "filename").agg(ids.alias("ids"))
    chunk = F.transform("ids", lambda i: F.struct(i.alias("id"), F.array(F.lit(0.5)).cast("array<float>").alias("embedding")))
    head = F.struct(F.concat_ws("|", "source_id", "filename").alias("event_id"))
    messages = files.select(F.to_json(F.struct(head.alias("headers"), "source_id", F.lit("m").alias("model"), chunk.alias("chunks"))).alias("value"))
    return store.consumed(messages, nodes)[1]


@_query(f"""WITH n AS (SELECT DISTINCT chunk_id, source_id FROM chunk_data), gone AS (SELECT chunk_id FROM n WHERE source_id = 'atlas-monorepo'), e AS ({_NEXT})
SELECT 'nodes' AS what, count(*) AS n FROM n WHERE chunk_id NOT IN (SELECT * FROM gone) UNION ALL SELECT 'edges', count(*) FROM e WHERE src NOT IN (SELECT * FROM gone) AND dst NOT IN (SELECT * FROM gone)""")
def gr_detach_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of a source taken out with all edges that touch them."""
    chunks = _chunks(spark, sf_dir, "start_line")
    edges = graph.next_chunk(chunks, ["source_id", "filename"], ["start_line", "chunk_id"], "chunk_id")
    nodes, left = graph.detached(chunks, edges, chunks.where("source_id = 'atlas-monorepo'"), "chunk_id")
    return nodes.agg(F.lit("nodes").alias("what"), F.count("*").alias("n")).unionByName(left.agg(F.lit("edges").alias("what"), F.count("*").alias("n")))


@_query("""WITH e AS (SELECT DISTINCT source_id AS src, metadata.original_event_id AS dst FROM chunk_events WHERE metadata.original_event_id IS NOT NULL), n AS (SELECT DISTINCT source_id AS id FROM chunk_events)
SELECT count(*) AS nodes, count(*) FILTER (known) AS known FROM (SELECT id, true AS known FROM n UNION ALL SELECT DISTINCT dst, false FROM e WHERE dst NOT IN (SELECT id FROM n))""")
def gr_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges bring the nodes that are missing at their ends."""
    rows = table(spark, sf_dir, "chunk_events", ["source_id", "metadata"])
    nodes = rows.select(F.col("source_id").alias("id"), F.lit(True).alias("known")).distinct()
    edges = rows.select(F.col("source_id").alias("src"), F.col("metadata.original_event_id").alias("dst")).where("dst IS NOT NULL")
    return graph.placeholders(nodes, edges).agg(F.count("*").alias("nodes"), F.count_if("known").alias("known"))


@_query("""WITH RECURSIVE e AS (SELECT a, b FROM (SELECT doc_id AS a, doc_id // 2 AS b FROM documents WHERE doc_id > 1 UNION SELECT doc_id, doc_id + 7 FROM documents WHERE doc_id % 5 = 0)), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
d(node, dist) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT u.b, d.dist + 1 FROM d JOIN u ON u.a = d.node WHERE d.dist < 40), m AS (SELECT node, min(dist) AS dist FROM d GROUP BY node),
g AS (SELECT max(doc_id) AS goal FROM documents), p(step, node) AS (SELECT m.dist, g.goal FROM g JOIN m ON m.node = g.goal UNION ALL
SELECT p.step - 1, (SELECT min(u.a) FROM u JOIN m ON m.node = u.a AND m.dist = p.step - 1 WHERE u.b = p.node) FROM p WHERE p.step > 0)
SELECT step, node FROM p""")
def gr_shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shortest path between the first and the last document over derived edges."""
    docs = table(spark, sf_dir, "documents", ["doc_id"])
    edges = docs.where("doc_id > 1").select(F.col("doc_id").alias("src"), F.floor(F.col("doc_id") / 2).alias("dst")).unionByName(docs.where("doc_id % 5 = 0").select(F.col("doc_id").alias("src"), (F.col("doc_id") + 7).alias("dst")))
    return graph.shortest_path(edges, 1, docs.agg(F.max("doc_id")).first()[0])


@_query("""SELECT q.vec_id AS query, r.vec_id, r.score FROM (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q, LATERAL (
SELECT e.vec_id, e.label, round(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) / sqrt(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE) * x))) / sqrt(list_sum(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS score
FROM embeddings e ORDER BY 3 DESC, 1 LIMIT 10) r WHERE r.score >= 0.2""")
def vs_knn_postfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every row whose id is divisible by 100, those of at least 0.2 kept."""
    rows = table(spark, sf_dir, "embeddings")
    return graph.nearest(rows, rows.where("vec_id % 100 = 0"), 10, 0.2)


@_query("""SELECT q.vec_id AS query, r.vec_id, r.score FROM (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q, LATERAL (
SELECT e.vec_id, e.label, round(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) / sqrt(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE) * x))) / sqrt(list_sum(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS score
FROM embeddings e ORDER BY 3 DESC, 1 LIMIT 20) r WHERE r.label = 1""")
def vs_knn_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest of every row whose id is divisible by 100, those of one owner kept; a label stands for the owner."""
    rows = table(spark, sf_dir, "embeddings")
    return graph.nearest(rows, rows.where("vec_id % 100 = 0"), 20, owner="label", owner_value=F.lit(1))


@_query("""WITH n AS (SELECT DISTINCT chunk_id, source_id, filename, source_id || '|' || chunk_id || '|' || filename AS id FROM chunk_data)
SELECT source_id, count(*) AS chunks FROM n WHERE NOT (source_id = 'atlas-monorepo' AND ends_with(id, (SELECT '|' || max(filename) FROM n WHERE source_id = 'atlas-monorepo'))) GROUP BY source_id""")
def gr_delete_by_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes left after deleting those of a source whose composite id ends in a path."""
    nodes = _chunks(spark, sf_dir).withColumn("id", N.composite_id(F.col("source_id"), F.col("chunk_id"), F.col("filename")))
    own = nodes.where("source_id = 'atlas-monorepo'")
    path = own.agg(F.max("filename").alias("path"))
    gone = own.join(F.broadcast(path), F.col("id").endswith(F.concat(F.lit("|"), F.col("path")))).select("id")  # the path is one row
    left, _ = graph.detached(nodes, nodes.select(F.col("id").alias("src"), F.col("id").alias("dst")), gone)
    return left.groupBy("source_id").agg(F.count("*").alias("chunks"))


# --- lookups and roll-ups ------------------------------------------------------------------------


@_query("SELECT filename, count(*) AS reports, max(processed_at) AS last FROM file_metadata WHERE source_id = 'atlas-monorepo' GROUP BY filename")
def lk_files_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a source, by name."""
    rows = table(spark, sf_dir, "file_metadata", ["source_id", "filename", "processed_at"]).where("source_id = 'atlas-monorepo'")
    return rows.groupBy("filename").agg(F.count("*").alias("reports"), F.max("processed_at").alias("last")).orderBy("filename")


@_query(f"SELECT chunk_id, filename, strlen(content) AS bytes FROM {_CHUNKS} WHERE source_id = 'atlas-monorepo'")
def lk_chunks_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a source in order."""
    rows = table(spark, sf_dir, "chunk_data", ["chunk_id", "source_id", "filename", "content", "start_line", "end_line"]).where("source_id = 'atlas-monorepo'").distinct()
    return rows.select("chunk_id", "filename", F.octet_length("content").alias("bytes"), "start_line").orderBy("filename", "start_line").drop("start_line")


@_query("SELECT id, chunk_key, tombstone FROM chunk_snapshot WHERE source_id = 'atlas-monorepo' AND filename LIKE 'docs/%' GROUP BY ALL")
def lk_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of a source's documents, tombstones included."""
    return table(spark, sf_dir, "chunk_snapshot", ["id", "chunk_key", "tombstone", "source_id", "filename"]).where("source_id = 'atlas-monorepo' AND filename LIKE 'docs/%'").select("id", "chunk_key", "tombstone").distinct()


@_query(f"SELECT chunk_id, content FROM {_CHUNKS} WHERE chunk_id IN (SELECT min(chunk_id) FROM chunk_data GROUP BY source_id)")
def lk_chunk_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content of the first chunk by id of every source, looked up by id."""
    wanted = table(spark, sf_dir, "chunk_data", ["chunk_id", "source_id"]).groupBy("source_id").agg(F.min("chunk_id").alias("chunk_id")).select("chunk_id")
    return table(spark, sf_dir, "chunk_data", ["chunk_id", "content"]).join(wanted, "chunk_id", "left_semi").distinct()


@_query("SELECT l_partkey AS entity, l_orderkey AS file, l_linenumber AS line FROM lineitem WHERE l_suppkey = 7")
def lk_entities_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of a source by file and line; parts stand for entities, orders for files."""
    rows = table(spark, sf_dir, "lineitem", ["l_partkey", "l_orderkey", "l_linenumber", "l_suppkey"]).where("l_suppkey = 7")
    return rows.select(F.col("l_partkey").alias("entity"), F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line")).orderBy("file", "line")


@_query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i).*o.*') ORDER BY p_name, p_partkey LIMIT 100")
def lk_entities_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred entities whose name matches."""
    return table(spark, sf_dir, "part", ["p_partkey", "p_name"]).where(F.col("p_name").rlike("(?i).*o.*")).orderBy("p_name", "p_partkey").limit(100)


@_query("SELECT source_id, user_id, count(*) AS total_files, count(*) AS processed_files, arg_min(processed_at, filename || CAST(processed_at AS VARCHAR)) AS last_updated, true AS graph_built FROM file_metadata GROUP BY source_id, user_id")
def st_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processing status of every source and user; the time is that of the first file by name."""
    rows = table(spark, sf_dir, "file_metadata", ["source_id", "user_id", "filename", "processed_at"])
    first = F.min_by("processed_at", F.struct("filename", "processed_at"))
    return rows.groupBy("source_id", "user_id").agg(F.count("*").alias("total_files"), F.count("*").alias("processed_files"), first.alias("last_updated"), F.lit(True).alias("graph_built"))


@_query("SELECT source_id, count(*) AS total, count(*) FILTER (content IS NOT NULL AND strlen(content) <= 5242880) AS processed, count(*) FILTER (content IS NULL OR strlen(content) > 5242880) AS skipped, count(*) FILTER (content IS NULL) = 0 AS success FROM chunk_data GROUP BY source_id")
def ag_batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a run over every source."""
    good = F.col("content").isNotNull() & (F.octet_length("content") <= 5 * 1024 * 1024)
    rows = table(spark, sf_dir, "chunk_data", ["source_id", "content"])
    return rows.groupBy("source_id").agg(F.count("*").alias("total"), F.count_if(good).alias("processed"), F.count_if(~F.coalesce(good, F.lit(False))).alias("skipped"), (F.count_if(F.col("content").isNull()) == 0).alias("success"))


@_query("""WITH r AS (SELECT delivery_id AS seq, metadata.tenant_id AS client, topic AS path, CAST(floor(epoch(received_at)) AS BIGINT) AS t FROM chunk_events WHERE received_at IS NOT NULL),
c AS (SELECT *, count(*) OVER (PARTITION BY client, path ORDER BY t RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY client, path, t) + row_number() OVER (PARTITION BY client, path, t ORDER BY seq) AS n FROM r)
SELECT seq, n AS count, n <= 2 AS allowed, greatest(0, 2 - n) AS remaining, t + 3600 AS reset FROM c""")
def wn_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two requests an hour for each tenant and topic."""
    rows = table(spark, sf_dir, "chunk_events", ["delivery_id", "topic", "received_at", "metadata"])
    epoch = F.floor(F.unix_micros(F.col("received_at").cast("timestamp")) / 1_000_000)
    requests = rows.select(F.col("metadata.tenant_id").alias("client"), F.col("topic").alias("path"), epoch.alias("epoch_s"), F.col("delivery_id").alias("seq"))
    return limits.rate_limited(requests, 2, 3600, 86_400).select("seq", "count", "allowed", "remaining", "reset")


@_query("""SELECT batch_id, delivery_id, lead(delivery_id) OVER (PARTITION BY batch_id ORDER BY delivery_id) AS following FROM chunk_events""")
def wn_event_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delivery that follows in its batch."""
    own = Window.partitionBy("batch_id").orderBy("delivery_id")
    return table(spark, sf_dir, "chunk_events", ["batch_id", "delivery_id"]).withColumn("following", F.lead("delivery_id").over(own))


# --- events --------------------------------------------------------------------------------------


@_query(f"""SELECT chunk_id, CASE WHEN coalesce(filename, '') = '' THEN 'file_path cannot be empty' WHEN {_LANGUAGE_SQL.replace('ext IN', _EXT + ' IN')} IS NULL THEN 'language cannot be empty' WHEN coalesce(content, '') = '' THEN 'content cannot be empty' WHEN strlen(content) > 51200 THEN 'content exceeds 50KB limit'
  WHEN coalesce(start_line, 0) = 0 THEN 'start_line must be positive (1-based)' WHEN coalesce(end_line, 0) = 0 THEN 'end_line must be positive (1-based)' WHEN start_line > end_line THEN 'start_line cannot be greater than end_line'
  WHEN start_line % 7 = 0 THEN 'commit_id must be 40 characters (SHA-1)' WHEN start_line % 5 = 0 THEN 'commit_id must be hexadecimal' WHEN start_line % 3 = 0 THEN 'chunk_index must be less than total_chunks' END AS problem FROM {_CHUNKS}""")
def ev_validate_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first broken rule of chunk events, with planted faults."""
    line = F.col("start_line")
    rows = _chunks(spark, sf_dir, "content", "start_line", "end_line").select(
        "chunk_id", F.col("filename").alias("file_path"), N.language(F.col("filename")).alias("language"), "content", "start_line", "end_line",
        F.when(line % 7 == 0, F.repeat(F.lit("a"), 39)).when(line % 5 == 0, F.repeat(F.lit("g"), 40)).otherwise(F.repeat(F.lit("a"), 40)).alias("commit_id"), F.when(line % 3 == 0, 1).otherwise(0).alias("chunk_index"), F.lit(1).alias("total_chunks"),
    )
    return rows.select("chunk_id", events.violation("CODE_CHUNK_CREATED").alias("problem"))


@_query("""SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 'embedding length (64) does not match dimension (65)' WHEN vec_id % 5 = 0 THEN 'model cannot be empty' WHEN vec_id % 3 = 0 THEN 'model_version cannot be empty' END AS problem FROM embeddings""")
def ev_validate_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first broken rule of embedding events, with planted faults."""
    v = F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(v % 7 == 0, 65).otherwise(64).alias("dimension"), F.when(v % 5 == 0, "").otherwise("m").alias("model"), F.when(v % 3 != 0, "1").alias("model_version"))
    return rows.select("vec_id", events.violation("EMBEDDING_CREATED").alias("problem"))


@_query("""SELECT id, CASE WHEN length(coalesce(commit_id, '')) <> 40 THEN 'commit_id must be 40 characters (SHA-1)' WHEN NOT regexp_matches(commit_id, '^[0-9A-Fa-f]*$') THEN 'commit_id must be hexadecimal' END AS problem FROM (SELECT DISTINCT id, commit_id FROM chunk_snapshot)""")
def ev_validate_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completion events made of snapshots: a commit must be named."""
    return table(spark, sf_dir, "chunk_snapshot", ["id", "commit_id"]).distinct().select("id", events.violation("INGEST_COMPLETED").alias("problem"))


_HEX = "CASE WHEN strlen(coalesce({0}, '')) <> 40 THEN '{0} must be 40 characters (SHA-1)' WHEN NOT regexp_matches(coalesce({0}, ''), '^[0-9A-Fa-f]*$') THEN '{0} must be hexadecimal' END"
_PROVIDER = "CASE WHEN coalesce(provider, '') NOT IN ('github', 'gitlab', 'bitbucket') THEN 'unknown provider' END"


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "chunk_snapshot", ["id", "filename", "commit_id", "chunk_hash", "embedding_model", "tombstone"]).distinct()
    provider = F.when(F.col("tombstone"), "svn").when(F.length("filename") % 2 == 0, "github").otherwise("bitbucket")
    return rows.select("id", F.col("filename").alias("url"), F.when(F.length("filename") % 5 > 0, "main").alias("branch"), "commit_id", F.substring("chunk_hash", 1, 40).alias("old_commit"), F.coalesce("commit_id", F.substring("chunk_hash", 1, 40)).alias("new_commit"), F.col("embedding_model").alias("credential_ref"), provider.alias("provider"))


_SNAPSHOTS = """(SELECT DISTINCT id, filename AS url, CASE WHEN length(filename) % 5 > 0 THEN 'main' END AS branch, commit_id, substr(chunk_hash, 1, 40) AS old_commit, coalesce(commit_id, substr(chunk_hash, 1, 40)) AS new_commit, embedding_model AS credential_ref,
CASE WHEN tombstone THEN 'svn' WHEN length(filename) % 2 = 0 THEN 'github' ELSE 'bitbucket' END AS provider FROM chunk_snapshot)"""
_NONE = "CASE WHEN coalesce({0}, '') = '' THEN '{0} cannot be empty' END"


@_query(f"SELECT id, coalesce({_NONE.format('url')}, {_NONE.format('branch')}, {_HEX.format('commit_id')}, {_NONE.format('credential_ref')}, {_PROVIDER}) AS problem FROM {_SNAPSHOTS}")
def ev_validate_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest requests made of snapshots: the first broken rule."""
    return _snapshots(spark, sf_dir).select("id", events.violation("REPO_INGEST_REQUESTED").alias("problem"))


@_query(f"""SELECT id, coalesce({_NONE.format('url')}, {_NONE.format('branch')}, {_HEX.format('old_commit')}, {_HEX.format('new_commit')}, CASE WHEN old_commit = new_commit THEN 'old_commit and new_commit must be distinct' END,
{_NONE.format('credential_ref')}, {_PROVIDER}) AS problem FROM {_SNAPSHOTS}""")
def ev_validate_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates of repositories made of snapshots: the first broken rule."""
    return _snapshots(spark, sf_dir).select("id", events.violation("REPO_UPDATED").alias("problem"))


@_query("SELECT run_id, CASE WHEN status <> 'failed' THEN 'error_message cannot be empty' END AS problem FROM index_runs")
def ev_validate_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures made of runs: only a failed one has a message."""
    rows = table(spark, sf_dir, "index_runs", ["run_id", "status"]).withColumn("error_message", F.when(F.col("status") == "failed", "lost").otherwise(""))
    return rows.select("run_id", events.violation("INGEST_FAILED").alias("problem"))


@_query("SELECT 'e' || doc_id AS event_id, CAST(doc_id AS VARCHAR) AS document_id, coalesce(kind, '') AS title, source AS source_id, sha256(text) AS content_hash, lang AS updated_by FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND path IS NOT NULL AND doc_id % 4 <> 0")
def ev_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document updates read from messages, every fourth of another type; those without a field that must be there are left out."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "text", "source", "path", "kind", "lang", "created_at"])
    payload = F.struct(
        F.col("doc_id").cast("string").alias("document_id"), F.coalesce("kind", F.lit("")).alias("title"), F.col("source").alias("source_id"), F.col("path").alias("content_ref"), F.col("lang").alias("updated_by"),
        F.coalesce(F.col("created_at").cast("string"), F.lit("never")).alias("source_updated_at"), F.sha2("text", 256).alias("content_hash"),
    )
    kind = F.when(F.col("doc_id") % 4 == 0, "CHUNK_DEPRECATED").otherwise("DOCUMENT_UPDATED")
    messages = docs.select(F.to_json(F.struct(F.concat(F.lit("e"), "doc_id").alias("event_id"), kind.alias("event_type"), F.lit("c").alias("correlation_id"), payload.alias("payload"))).alias("value"))
    return contracts.extension_rows(messages, "DOCUMENT_UPDATED").select("event_id", "document_id", "title", "source_id", "content_hash", "updated_by")


@_query("SELECT doc_id, n_chars, 'raw' AS chunk_type, false AS pii_detected, CASE WHEN doc_id % 2 = 0 THEN 2 END AS dimension FROM documents")
def ev_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes of the documents as JSON and back, with the defaults of what wasn't said."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "text", "n_chars"])
    vector = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(0.5), F.lit(1.5)).cast("array<float>"))
    sent = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("chunk_text"), vector.alias("embedding"), F.col("n_chars").cast("string").alias("group_id"))
    back = contracts.episodes_of(contracts.episode_json(sent))
    return back.select(F.col("id").cast("bigint").alias("doc_id"), F.col("group_id").cast("bigint").alias("n_chars"), "chunk_type", "pii_detected", F.col("embedding_dimension").alias("dimension"))


def _field_sql(name: str, value: str, first: bool = False) -> str:
    return f"coalesce('{'' if first else ','}\"{name}\":' || CAST(to_json({value}) AS VARCHAR), '')"



@_query(f"""WITH c AS (SELECT *, {_EXT} AS ext FROM {_CHUNKS}), l AS (SELECT *, {_LANGUAGE_SQL} AS language FROM c),
t AS (SELECT *, CASE WHEN language IS NOT NULL THEN 'code:File' WHEN filename LIKE 'http%' THEN 'web:PageOverview' ELSE 'doc:DocumentOverview' END AS chunk_type FROM l),
v AS (SELECT chunk_id AS key, '{{"headers":{{"event_id":' || to_json(chunk_id) || ',"event_type":"CHUNK_RAW","source_service":"chunkloom"' || {_field_sql('correlation_id', 'source_id')} || '}},"metadata":{{"retry_count":0,"user_id":"system"}}' || {_field_sql('source_id', 'source_id')}
  || ',"chunks":[{{"id":' || to_json(chunk_id) || {_field_sql('file_id', 'filename')} || {_field_sql('chunk_type', 'chunk_type')} || {_field_sql('content', 'content')} || {_field_sql('language', 'language')} || {_field_sql('start_line', 'start_line')} || {_field_sql('end_line', 'end_line')} || '}}]}}' AS value FROM t)
SELECT key, strlen(value) >= 10240 AS too_large, sha256(value) AS hash FROM v""")
def ev_chunk_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk messages with their size check."""
    rows = _chunks(spark, sf_dir, "content", "start_line", "end_line").select(
        F.col("chunk_id").alias("id"), "source_id", F.col("filename").alias("file_id"), N.chunk_type(F.col("filename")).alias("chunk_type"), "content", N.language(F.col("filename")).alias("language"), "start_line", "end_line", F.lit("system").alias("user_id"), F.lit(True).alias("is_dirty")
    )
    sent = events.chunk_events(rows)
    return sent.select("key", events.too_large(F.col("value")).alias("too_large"), F.sha2("value", 256).alias("hash"))


@_query(_FOLD + """, e AS (SELECT d.source, c.doc_id, ordinal, content, lead(ordinal) OVER (PARTITION BY c.doc_id ORDER BY ordinal) AS following FROM chunk c JOIN documents d ON d.doc_id = c.doc_id)
SELECT source, count(*) AS chunks, count(following) AS next_edges, count(DISTINCT sha256(content)) AS distinct_contents FROM e GROUP BY source""")
def ch_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents to chunks with identity and reading order, rolled up by source."""
    return _flagship(_documents(spark, sf_dir))


def _flagship(documents: DataFrame) -> DataFrame:
    rows = chunking.hybrid_chunks(documents, ["doc_id", "source"]).withColumn("filename", F.concat(F.lit("doc_"), F.col("doc_id")))
    known = identity.identified(rows, "source", "filename").select("source", "doc_id", "ordinal", "id", "chunk_hash")
    own = Window.partitionBy("doc_id").orderBy("ordinal")
    read = known.withColumn("following", F.lead("id").over(own))
    return read.groupBy("source").agg(F.count("*").alias("chunks"), F.count("following").alias("next_edges"), F.count_distinct("chunk_hash").alias("distinct_contents"))
