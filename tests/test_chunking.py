import json
import random

from pyspark.sql import functions as F

from chunkloom.operators import chunking as C
from chunkloom.operators import parsing as P


def size(s):
    return len(s.encode())


def brute_packed(text, limit, overlap):
    """Plain re-statement of the packing rules over a list of pieces."""
    if size(text) <= limit:
        return [text]
    out, cur = [], ""

    def tail(c):
        if size(c) <= overlap:
            return ""
        keep, n = [], 0
        for w in reversed(c.split()):
            if n + size(w) + 1 > overlap:
                break
            keep.insert(0, w)
            n += size(w) + 1
        return "".join(w + " " for w in keep)

    for p in filter(None, (p.strip() for p in text.split("\n\n"))):
        cut = p.split(". ") if size(p) > limit else [p]
        for k, s in enumerate(cut):
            s = s + "\n\n" if len(cut) == 1 else s + ". " if k < len(cut) - 1 else s
            if cur and size(cur) + size(s) > limit:
                out.append(cur.strip())
                cur = tail(cur)
            if size(s) <= limit:
                cur += s
                continue
            for w in s.split():
                if size(w) > limit:
                    out += [cur.strip()] * bool(cur)
                    cur = ""
                    out += [w[i : i + limit] for i in range(0, len(w), limit)]
                else:
                    if cur and size(cur) + size(w) + 1 > limit:
                        out.append(cur.strip())
                        cur = tail(cur)
                    cur += w + " "
    return out + [cur.strip()] * bool(cur.strip())


def texts():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdé漢") for _ in range(r.choice([1, 3, 6, 6, 9])))
    made = [" ".join(word() + r.choice(["", "", "", ".", "\n\n", "\n"]) for _ in range(r.choice([0, 5, 60, 300]))) for _ in range(25)]
    return made + ["", " ", "x" * 950, "é" * 700, "a " * 600, "x" * 399 + "\n\n" + "y" * 400, "p. " * 300, "one\n\none\n\n" * 80, "w" * 900 + " b. c " + "d " * 300]


def test_packing_against_brute_force(spark):
    for limit, overlap in ((400, 60), (300, 0)):
        rows = [(k, t) for k, t in enumerate(texts())]
        got = spark.createDataFrame(rows, "k int, text string").select("k", C.packed(F.col("text"), limit, overlap).alias("p")).collect()
        assert {r.k: r.p for r in got} == {k: brute_packed(t, limit, overlap) for k, t in rows}


def test_positions_ids_and_nulls(spark):
    rows = [(1, "aé " * 700), (2, None), (3, ""), (4, "short")]
    got = C.hybrid_chunks(spark.createDataFrame(rows, "k int, text string").withColumn("content", F.lit("clash")), ["k"]).collect()
    assert {r.k for r in got} == {1, 3, 4}
    for r in got:
        text = dict(rows)[r.k].encode()
        at = text.find(r.content.encode())
        assert r.start == max(0, at) and r.end == r.start + size(r.content)


def test_json_packing(spark):
    items = [{"b": k, "a": ["x" * (k % 50), None, 1.5]} for k in range(60)] + ["y" * 500]
    whole = {f"k{k:02d}": {"z": k, "a": "é" * k} for k in range(40)}
    rows = [(1, json.dumps(items)), (2, json.dumps(whole)), (3, "[]" + " " * 500), (4, "{broken" + "x " * 300), (5, "[1]")]
    got = {r.k: r.p for r in spark.createDataFrame(rows, "k int, text string").select("k", C.packed_json(F.col("text"), 300).alias("p")).collect()}
    assert [x for c in got[1] for x in json.loads(c)] == items and all(size(c) <= 300 or len(json.loads(c)) == 1 for c in got[1])
    joined: dict = {}
    for c in got[2]:
        joined |= json.loads(c)
    assert joined == whole and all(size(c) <= 300 for c in got[2])
    assert got[3] == ["{}"] and got[4] is None and got[5] == ["[1]"]


def test_balanced_parts(spark):
    r = random.Random(2)
    rows = [(k, "\n\n".join("\n".join("w" * r.choice([0, 10, 80, 700]) for _ in range(r.randrange(1, 6))) for _ in range(r.randrange(1, 12)))) for k in range(20)] + [(100, "x" * 2000), (101, "short")]
    got = {x.k: x.p for x in spark.createDataFrame(rows, "k int, text string").select("k", C.balanced(F.col("text"), 500).alias("p")).collect()}
    for k, text in rows:
        parts = got[k]
        assert "".join("".join(parts).split()) == "".join(text.split())
        assert size(text) > 500 or parts == [text]
        assert all(size(p) <= 1000 for p in parts)


def test_document_chunks(spark):
    s = "heading string, level int, content string"
    schema = f"k int, title string, sections array<struct<{s}>>, tables array<struct<caption:string,markdown:string>>".replace("heading string, level int, content string", "heading:string,level:int,content:string")
    rows = [
        (1, "T", [("A", 1, "  "), ("B", 2, "body"), ("", 1, "tail")], [("cap", "|a|"), (None, " "), ("", "|b|")]), (2, None, None, None), (3, "L", [("H", 3, "word " * 900)], []),
        (4, "W", [("", 1, "p" * 60_000 + "\n\n" + "q" * 60_000)], None),
    ]
    got = {}
    for x in sorted(C.document_chunks(spark.createDataFrame(rows, schema), ["k"]).collect(), key=lambda x: (x.k, x.ordinal)):
        got.setdefault(x.k, []).append(x)
    assert [x.content for x in got[1]] == ["# T\n\n## Document Structure\n# A\n## B\n\n---\n\n## B\n\nbody", "tail", "Table: cap\n\n|a|", "|b|", "# A\n\n## B\n\nbody\n\ntail\n\nTable: cap\n\n|a|\n\n|b|\n\n"]
    assert 2 not in got
    assert [x.kind for x in got[3]] == ["Section", "Paragraph", "DocumentOverview"] or got[3][1].content.startswith("[cont. H]\n\n")
    assert got[4][-1].content == "p" * 60_000


def test_markdown_state_machine(spark):
    text = "pre\n# One\na\n\nb\n<!-- TABLE -->\nCaption: Cap\n| x |\n|---|\n| y |\nafter\n####### Deep\nz\n<!-- TABLE -->\nno rows\n<!-- TABLE -->\n| end |"
    rows = [(1, text), (2, "only text"), (3, "  "), (4, None), (5, "# head")]
    df = spark.createDataFrame(rows, "k int, text string")
    got = sorted((r.k, r.pos, r.heading, r.level, r.content) for r in P.markdown_sections(df, ["k"]).collect())
    assert got == [
        (1, 0, "", 1, "pre"), (1, 1, "One", 1, "a\n\n\n\nb"), (1, 2, "One", 1, "after"), (1, 3, "Deep", 6, "z"), (1, 4, "Deep", 6, "no rows"), (2, 0, "", 1, "only text"), (5, 0, "", 1, "# head"),
    ]
    assert [(r.k, r.pos, r.caption, r.markdown) for r in P.markdown_tables(df, ["k"]).orderBy("k", "pos").collect()] == [(1, 0, "Cap", "| x |\n|---|\n| y |"), (1, 1, "", "| end |")]
