"""Queries that do the whole of what SQL can only follow in part, against brute force on small tables."""

import hashlib
import json

import __spark_entry__ as entry


def run(spark, folder, query, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return entry.queries()[query](spark, str(folder))


def packed(text):
    value = json.loads(text)
    array = isinstance(value, list)
    dump = lambda v: json.dumps(v, separators=(",", ":"))
    items = [dump(v) for v in value] if array else [dump({k: value[k]})[1:-1] for k in sorted(value)]
    out, now, size = [], [], 2
    for x in items:
        if now and size + len(x) + 2 > 1500:
            out.append(now)
            now, size = [], 2
        now.append(x)
        size += len(x) + 2
    return [("[%s]" if array else "{%s}") % ",".join(x) for x in [*out, now]]


def test_large_json_documents_are_chunked(spark, tmp_path):
    array = json.dumps([{"id": k, "text": "word " * 20} for k in range(40)], indent=1)
    entries = " \n" + json.dumps({f"key{k}": ["v" * 50, k] for k in range(60)})
    texts = {1: array, 2: entries, 3: "[1, 2]", 4: "plain text", 5: None}
    want = {(d, i, c) for d, t in texts.items() if t for i, c in enumerate(packed(t) if d < 3 else [t])}
    table = {"documents": ([(d, "json" if d < 3 else "text", f"p{d}", t) for d, t in texts.items()], "doc_id bigint, source string, path string, text string")}
    got = run(spark, tmp_path, "ch_hybrid_text", **table)
    assert sorted((r.doc_id, r.ordinal, r.hash) for r in got.collect()) == sorted((d, i, hashlib.sha256(c.encode()).hexdigest()) for d, i, c in want)
    of = {s: [c for d, _, c in want if (d < 3) == (s == "json")] for s in ("json", "text")}
    assert {tuple(r) for r in run(spark, tmp_path, "ch_stats").select("source", "chunks", "avg_bytes").collect()} == {(s, len(c), sum(map(len, c)) // len(c)) for s, c in of.items()}
    got = run(spark, tmp_path, "ch_flagship").select("source", "chunks", "next_edges", "distinct_contents").collect()
    assert {tuple(r) for r in got} == {(s, len(c), len(c) - 2, len(set(c))) for s, c in of.items()}


def test_every_table_of_an_output_is_read(spark, tmp_path):
    grid = lambda k: f"| a{k} | b |\n|---|---|\n| {k} | y |"
    latex = "\\begin{tabular}{ll}\nx & y\n\\end{tabular}"
    rows = [(1, [("one", grid(1)), (None, grid(2)), ("tex", latex), ("last", grid(3))]), (2, [("tex", latex), ("two", grid(4))]), (3, [("none", None)]), (4, []), (5, None)]
    schema = "output_id bigint, tables array<struct<caption:string,markdown:string>>"
    got = run(spark, tmp_path, "ch_markdown_tables", pipeline_output=(rows * 2, schema)).collect()
    want = [(1, 0, "one", 1), (1, 1, "", 2), (1, 2, "last", 3), (2, 0, "two", 4)]
    assert sorted((r.output_id, r.pos, r.caption, r.hash) for r in got) == [(o, p, c, hashlib.sha256(grid(k).encode()).hexdigest()) for o, p, c, k in want]


def test_stems_are_found_inside_longer_words(spark, tmp_path):
    files = ["src/load.py", "a/save_page.generated.ts", "x/io.rs", "b/über.md", "c/日本.md", "d/-.md", "e/q.c", "f/load.rs", "g/loads.py"]
    texts = ["preloading rows", "import save_page.generated; save_pages", "save_page-generated and studio", "größe übersicht", "日本語 text", "a-b q", "", None, "loads of save_page.generatedX"]
    rows = [(f"c{k}", "s" if k != 3 else "t", f, t, 1, 2) for k, (f, t) in enumerate(zip(files, texts, strict=True))] + [("c9", "t", "z/other.md", "load über", 1, 2)]
    stem = lambda f: f.rsplit("/", 1)[1].rsplit(".", 1)[0]
    want = {(c, f) for c, s, own, t, *_ in rows for _, of, f, *_ in rows if s == of and f != own and stem(f) in (t or "")}
    schema = "chunk_id string, source_id string, filename string, content string, start_line int, end_line int"
    got = run(spark, tmp_path, "rx_reverse_contains", chunk_data=(rows * 2, schema)).select("chunk_id", "target").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 6


def test_pages_of_all_documents(spark, tmp_path):
    from chunkloom.operators import graph

    rows = [(1, "a"), (2, "b"), (3, None), (4, "c"), (5, "a"), (6, "d")]
    got = run(spark, tmp_path, "gr_web_links", documents=([(d, "s", p, "t") for d, p in rows], "doc_id bigint, source string, path string, text string"))
    assert sorted(map(tuple, got.select("url", "kind", "links").collect())) == [("a", "page", 2), ("b", "page", 0), ("c", "page", 1), ("d", "page", 0)]
    pages = spark.createDataFrame([("a", "page")], "url string, kind string")
    every, kept = graph.linked_pages(pages, spark.createDataFrame([("a", "b"), ("x", "y"), ("x", "a")], "src string, dst string"))
    assert sorted((r.url, r.kind) for r in every.collect()) == [("a", "page"), ("b", None)] and [tuple(r) for r in kept.select("src", "dst").collect()] == [("a", "b")]
