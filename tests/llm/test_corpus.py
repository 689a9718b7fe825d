"""Operators that look across texts: scans, provenance, leaks, look-alikes."""

import os
import random
import re
from datetime import datetime

import pytest

from chunkloom.llm import leaks as L
from chunkloom.llm import lookalikes as K
from chunkloom.llm import provenance as V
from chunkloom.llm import scans as S
from chunkloom.llm.vocab import TOKENIZERS

pytestmark = pytest.mark.skipif(not os.path.isdir(TOKENIZERS), reason="no tokenizer files here")
OUTPUTS = "output_id bigint, title string, sections array<struct<heading:string,level:int,content:string>>, part_kind string"
CLEAN = "The reviewer merged the manifest before the snapshot was restored. Commit after commit the tombstone stays regional and nobody owns it."


def sections(*texts):
    return [("h", 1, t) for t in texts]


def test_scan_faults_and_decoys(spark):
    good = [sections(CLEAN, "Wrapped lines\nalone are no fault here.", "NOTE\nCapital headings stay.\nEND OF NOTE", "quota = 137\ntopic = 20", "utf8 text and sha256, l10n, i18n at p50 and p99 from 0x1F", "two- and three-fold, pre- and post-run")] * 20
    bad = {
        "cut": "the manif-\nest is kept", "soft": "the qui\xad\netly kept", "over header": "the rep-\nHARBOUR EDGE MANUAL  REV 5\nort is kept", "torn": "the rate lim it~er counts", "spaced": "the s t o r a g e crew", "ligature": "the backﬁll driver",
        "page": "it ends.\n— 53 —\nnext begins", "roman": "xvii\nIt begins", "slash": "ends here\n97/127", "header": "the\nCORDOBA MANIFEST HANDBOOK  CONFIDENTIAL COPY\nmanifest", "digit": CLEAN.replace("snapshot", "snapsh0t"), "rn": CLEAN.replace("tombstone", "tornbstone"),
    }
    rows = [(k, "Operating The Chunk Store", s, "clash") for k, s in enumerate(good)]
    rows += [(100 + k, None, sections(CLEAN, t), "clash") for k, t in enumerate(bad.values())] * 2
    titles = ["Utf8 And Byte Offsets", "Top 10 Retry Causes", "Read-Only Replicas", "Chapter 12 Retention", "Event Relay Rele-\nase Notes", "ix    Table Guide", "Loader Guide .... 12", "70\nTitle Notes", "Temp- orary Windows", "- 44 - Node Guide", "Store [35]", ""]
    rows += [(200 + k, t, None, "clash") for k, t in enumerate(titles)]
    df = spark.createDataFrame(rows, OUTPUTS)
    got = {tuple(r) for r in S.faulty_parts(df).collect()}
    assert got == {(100 + k, "section", 1) for k in range(len(bad))} | {(200 + k, "title", 0) for k in range(4, 11)}
    assert S.faulty_parts(df.limit(0)).count() == 0


def test_repair(spark):
    noisy = "The rev iew~er merged the mani-\nHARBOUR EDGE MANUAL  REV 5\nfest before the snapsh0t\nwas restored.\n— 3 —\n\nA second p a r a graph."
    rows = [(k, "T", sections(CLEAN), "c") for k in range(20)] + [(50, "ix    Ta- bles", sections(noisy.replace("p a r a graph", "b r e a k")), "c"), (51, None, [None, ("h", 1, None)], "c")]
    got = {(r.output_id, r.part_kind): r.text for r in S.repaired_parts(spark.createDataFrame(rows, OUTPUTS)).collect()}
    assert got[(50, "section")] == "The reviewer merged the manifest before the snapshot was restored.\n\nA second break."
    assert got[(50, "title")] == "Tables" and got[(3, "section")] == CLEAN and not any(k[0] == 51 for k in got)


def test_the_document_supports_a_rare_form(spark):
    word = lambda t: sections(f"Notes on the {t} line of the yard.", f"The Harbourmoor line again.")
    rows = [(k, None, sections(f"A plain Harbourmoor text {k}."), "c") for k in range(3)] + [(50, None, word("Harb0urmoor"), "c"), (51, None, sections("Notes on the Harb0urmoor line of the yard."), "c")]
    frame = spark.createDataFrame(rows, OUTPUTS)
    assert [tuple(r) for r in S.faulty_parts(frame).collect()] == [(50, "section", 0)]  # too rare to tell without its document
    got = {(r.output_id, r.part_pos): r.text for r in S.repaired_parts(frame).collect()}
    assert got[(50, 0)] == "Notes on the Harbourmoor line of the yard." and "Harb0urmoor" in got[(51, 0)]


def test_repair_keeps_code(spark):
    code = "```py\ndef f(x):\n  if x-\n  y:\n\n    return 1\n  return 2\n12\n```"
    text = f"The mani-\nfest was\nmerged:\n\n{code}\n\nand then\nrestored.\n\n    indented  code\n    a = snapsh0t\n\nThe snapsh0t\nagain."
    rows = [(k, "T", sections(CLEAN), "c") for k in range(20)] + [(60, None, sections(text), "c")] * 2
    got = {(r.output_id, r.part_kind): r.text for r in S.repaired_parts(spark.createDataFrame(rows, OUTPUTS)).collect()}
    assert got[(60, "section")] == f"The manifest was merged:\n\n{code}\n\nand then restored.\n\n    indented  code\n    a = snapsh0t\n\nThe snapshot again."


FILES = "source_id string, filename string, file_type string, size_bytes int, line_count int, processed_at timestamp, kind string"
CHUNKS = "source_id string, filename string, content string, start_line int, metadata map<string,string>"
BODY = "def load(rows):\n    total = 0\n    for r in rows:\n        total += r.size\n    return total\n"


def test_provenance_evidence(spark):
    t = datetime(2025, 1, 1)
    hand = ["# Written by hand, do not regenerate\n" + BODY, "# Uses parsekit 2.9.21 for parsing\n" + BODY, BODY * 4 + "# The writer puts a line 'DO NOT EDIT' on top\n", "# Copyright Atlas platform team\n" + BODY, 'KEY = "' + "aZ9" * 160 + '"\n' + BODY * 3]
    made = ["# Code generated by stubforge v4. DO NOT EDIT.\n" + BODY, "// @generated by schemagen\n" + BODY, "# Dieses Modul wurde maschinell erzeugt. Nicht bearbeiten.\n" + BODY, "// Copyright 2010-2015 quickqueue contributors\n// Bundled copy, upstream at https://q.example\n" + BODY,
            "!function(t,e){" + "var h=276,k=[];function q(e,j){return e>j?e.batch:j[11]}" * 20 + "}", "DATA = [\n" + "    40158, 21004, 12054,\n" * 60 + "]\n", 'export const D = "' + "o7fSNeKhRgDDaATegO1iX8" * 90 + '"']
    by_path = ["vendor/x/a.py", "tools/Pods/lib/x.cpp", "src/parsekit-1.1.16/src/m.c", "a/b_pb2.py", "a/deps.lock.json", "a/x.min.js", "a/generated/x.ts", "assets/x.d2893bbc.js"]
    not_by_path = ["a/vendor.py", "a/generate_report.py", "a/generated_column_test.py", "suppliers/x.py", "codegen/x.py", "a/minify_tool.js"]
    files, chunks = [], []
    for k, x in enumerate(hand + made):
        files.append(("s", f"f{k}.py", "code", len(x), x.count("\n") + 1, t, "clash"))
        chunks.append(("s", f"f{k}.py", x, 1, None))
    files += [("s", p, "config" if "lock" in p else "code", 100, 10, t, "c") for p in by_path + not_by_path] * 2
    files += [("s", "wide.js", "code", 90_000, 2, t, "c"), ("s", "doc.min.md", "document", 9, 1, t, "c"), ("s", "null.py", "code", None, None, None, "c"), ("s", None, "code", 1, 1, t, "c")]
    chunks += [("s", "null.py", None, None, None), ("other", "orphan.py", made[0], 1, None), ("s", "f0.py", "", 0, {"chunk_index": "3"})]
    F_, C_ = spark.createDataFrame(files, FILES), spark.createDataFrame(chunks, CHUNKS)
    got = {r.filename for r in V.not_handwritten(F_, C_).collect()}
    assert got == {f"f{k}.py" for k in range(len(hand), len(hand + made))} | set(by_path) | {"wide.js"}
    assert V.not_handwritten(F_.limit(0), C_.limit(0)).count() == 0


def test_families_and_copies(spark):
    t = datetime(2025, 1, 1)
    r = random.Random(1)
    name = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    body = lambda extra="": "".join(f"fn {name()}(x: u8) -> u8 {{ if x > {r.randrange(99)} {{ return {name()}(x)?; }} x * {r.randrange(9)} + {name()}[{k}] }}{extra}\n" for k in range(12))
    copy = "\n".join(f"let {name()} = {name()}({k}) + {name()};" for k in range(25))
    rows = [("r1", f"gen{k}.rs", "// @generated\n" + body()) for k in range(6)] + [("r1", "bare.rs", body())] + [("r2", "copy.rs", copy), ("r3", "copy.rs", "// other comment\n" + copy)]
    rows += [("r4", f"hand{k}.rs", body(" // hand") + "struct S { a: u8, b: [u8; 4], c: &'static str }\nimpl S { fn n(&self) -> u8 { match self.a { 0 => 1, _ => self.b[0] } } }\n" * 8) for k in range(4)]
    files = spark.createDataFrame([(s, f, "code", len(x), x.count("\n") + 1, t, "") for s, f, x in rows], FILES)
    chunks = spark.createDataFrame([(s, f, x, 1, {"chunk_index": "0"}) for s, f, x in rows], CHUNKS)
    got = {(x.source_id, x.filename): x.kind for x in V.not_handwritten(files, chunks).collect()}
    assert got == {("r1", f"gen{k}.rs"): "generated" for k in range(6)} | {("r1", "bare.rs"): "generated", ("r2", "copy.rs"): "vendored", ("r3", "copy.rs"): "vendored"}


def test_head_lines_are_banners_by_the_paths_of_their_files(spark, monkeypatch):
    t = datetime(2025, 1, 1)
    strange = "// Tämä tiedosto on koneen tekemä, älä koske (build {})\n"  # no phrase of any list
    rows = [(f"r{k % 3}", f"gen/generated/a{k}.rs", strange.format(k) + BODY + f"x{k} = 1\n") for k in range(12)] + [("r4", "src/plain.rs", strange.format(77) + BODY + "y = 2\n")]
    rows += [(f"r{k % 3}", f"{'vendor' if k < 12 else 'lib'}/tool{k}/m.rs", "# Keep in step with the mother project of tinygrid\n" + BODY + f"z{k} = {k}\n") for k in range(24)]
    rows += [("r5", f"src/h{k}.rs", "# Part of the house rules of the team\n" + BODY + f"w{k} = 5\n") for k in range(9)] + [("r5", "vendor/h9.rs", "# Part of the house rules of the team\n" + BODY)]
    files = spark.createDataFrame([(s, f, "code", len(x), x.count("\n") + 1, t, "") for s, f, x in rows], FILES)
    chunks = spark.createDataFrame([(s, f, x, 1, {"chunk_index": "0"}) for s, f, x in rows], CHUNKS)
    got = {x.filename: x.kind for x in V.not_handwritten(files, chunks).collect()}
    assert got == {f"gen/generated/a{k}.rs": "generated" for k in range(12)} | {"src/plain.rs": "generated", "vendor/h9.rs": "vendored"} | {f"{'vendor' if k < 12 else 'lib'}/tool{k}/m.rs": "vendored" for k in range(24)}
    whole = V.banner_families
    monkeypatch.setattr(V, "banner_families", lambda lines: whole(lines).where("false"))
    assert "src/plain.rs" not in {x.filename for x in V.not_handwritten(files, chunks).collect()}


def brute_leaks(docs, items):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for i, text in items:
        w = words(text)
        grams = {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
        for d, doc in docs:
            x = words(doc)
            if any(tuple(x[k : k + 12]) in grams for k in range(len(x) - 11)):
                out.add((d, i))
    return out


def test_leaks_against_brute_force(spark):
    r = random.Random(6)
    vocabulary = ["a", "to", "ünder", "漢字", "mill", "seven", "42", "glazier", "barrels", "of"]
    say = lambda n, sep=" ": sep.join(r.choice(vocabulary) for _ in range(n))
    items = [(k, say(r.choice([5, 11, 12, 13, 40]))) for k in range(25)] + [(98, None), (99, "")]
    docs = []
    for d in range(120):
        w = (r.choice(items)[1] or "x").split()
        n = r.choice([11, 12, 13, 30])
        at = r.randrange(max(1, len(w) - n + 1))
        inside = r.choice([" ", ", ", "\r\n", " - ", "_"]).join(w[at : at + n])
        docs.append((d, say(r.randrange(30)) + r.choice([" ", ". ", ""]) + r.choice([str.upper, str])(inside) + r.choice([" ", "!"]) + say(r.randrange(30))))
    docs += [(500, None), (501, ""), (502, say(40_000) + " " + items[20][1] + " " + say(10))]
    D = spark.createDataFrame([(d, t, "clash") for d, t in docs] * 2, "doc_id bigint, text string, item_id string")
    I_ = spark.createDataFrame(items * 2, "item_id bigint, text string")
    want = brute_leaks(docs, items)
    got = L.leaks(D, I_).collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want) and want
    assert {tuple(x) for x in L.leaks(D, I_, block_chars=200).collect()} == want  # several passes
    assert L.leaks(D, I_.limit(0)).count() == 0 and L.leaks(D.limit(0), I_).count() == 0


def distance_within(passage, text):
    """Least edit distance of the passage and any part of the text."""
    row = [0] * (len(text) + 1)
    for k, c in enumerate(passage):
        now = [k + 1]
        for j, d in enumerate(text):
            now.append(min(row[j] + (c != d), row[j + 1] + 1, now[j] + 1))
        row = now
    return min(row)


@pytest.mark.parametrize("edits", [0, 1, 2, 3])
def test_leaks_with_edits_against_brute_force(spark, edits):
    r = random.Random(40 + edits)
    vocabulary = ["a", "to", "ünder", "漢字", "mill", "seven", "42", "glazier"]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(k, say(r.choice([12, 13, 16]))) for k in range(8)]
    docs = []
    for d in range(60):
        inside = list(" ".join(r.choice(items)[1].split()[:13]))
        for _ in range(r.randrange(0, 5)):
            at = r.randrange(len(inside))
            inside[at : at + r.choice([0, 1])] = r.choice(["", "x", "q"])
        docs.append((d, f"{say(r.randrange(6))} {''.join(inside)} {say(r.randrange(6))}"))
    passages = {k: [" " + " ".join(t.split()[a : a + 12]) + " " for a in range(len(t.split()) - 11)] for k, t in items}
    want = {(d, k) for d, t in docs for k, own in passages.items() if min(distance_within(p, L.plain_words(t)) for p in own) <= edits}
    got = L.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), edits=edits)
    assert {tuple(x) for x in got.collect()} == want and want


def test_regions_in_windows(monkeypatch):
    r = random.Random(5)
    say = lambda n: " ".join("".join(r.choice("abcdefg") for _ in range(r.randrange(1, 8))) for _ in range(n))
    items = [(k, say(30)) for k in range(5)]
    text = " ".join(say(r.randrange(100)) + " " + items[k % 5][1] for k in (3, 1, 4, 3))
    whole = L.Items(items).leaked(text)
    monkeypatch.setattr(L, "WINDOW", 16)
    assert L.Items(items).leaked(text) == whole == [1, 3, 4]


def test_canonical_forms():
    plain = "The café clock, fi 10 №? Aport\n"
    same = ["Ｔhe café clock, fi 10 №? Aport\n", "The café сlосk, fi 10 №? Aport\n", "The c\u200bafé\u00a0clock, ﬁ 10 №? \u0391port\n", "The\u2009cafe\u0301 clo\u00adck,\u3000fi 10 №? Αpοrt\n", "Τhe café clock, fi 10 №? Aport\ufeff\n"]
    other = [plain.replace("é", "e"), plain.replace("c", "C", 1), plain.replace("10", "1O"), plain.replace("10", "1⁰"), plain.replace(",", ""), plain.replace("\n", "\n\n"), plain.replace(" ", "  ", 1), plain.replace("l", "1", 1)]
    assert {K.canonical(t) for t in same} == {K.canonical(plain)}
    assert len({K.canonical(t) for t in [plain, *other]}) == 1 + len(other)
    assert K.canonical("нода и the узел") == "нода и the узел" and K.canonical("👩\u200d💻") != K.canonical("👩💻")
    assert K.canonical("plain ascii\t\r\n x") == "plain ascii\t\r\n x" and K.canonical("ノ") == K.canonical("ﾉ") and K.canonical("ｶﾞ") == K.canonical("ガ")


def test_trie_automaton_agrees_with_the_table():
    own = K.trie("byte_bpe_50k", TOKENIZERS)
    assert own.spelling("сat") == "cat" or own.spelling("сat") is None
    assert own.spelling("documеnt") == "document" and own.spelling("documxnt") is None and own.spelling("documxnt", 1) == "document"
    r = random.Random(2)
    swap = {b: a for a, b in K._LATIN.items()}
    for word in ["document", "because", "table", "notaword", "zzqx", "people"]:
        for _ in range(20):
            odd = "".join(r.choice([c, swap.get(c, c), c + "\u200b"]) for c in word)
            assert K.canonical_token(odd) == K.canonical_token(word) == word


def test_pairs(spark):
    rows = [(1, "cafe one"), (2, "сafe one"), (3, "cafe one"), (4, "cafe\u00a0one"), (5, None), (6, ""), (7, "\u200b \u00a0"), (8, " "), (9, "other"), (10, "othеr" * 1), (11, "Other"), (12, "x" * 300_000 + "\u00e9"), (13, "x" * 300_000 + "e\u0301")]
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows] * 2, "doc_id bigint, text string, look string")
    assert sorted(map(tuple, K.same_looks(df).collect())) == [(1, 2), (1, 4), (2, 3), (2, 4), (3, 4), (9, 10), (12, 13)]
    assert K.same_looks(df.limit(0)).count() == 0


def test_families_are_those_of_all_pairs(spark):
    r = random.Random(4)
    marks = "+-*/%&|^~<>?!.;:="
    texts = []
    for _ in range(12):
        head = [r.choice(marks) for _ in range(70)]  # shared, so that unlike texts meet in buckets
        for _ in range(4):
            own = head + [r.choice(marks) for _ in range(r.choice([8, 25, 60]))]
            for _ in range(8):
                own = list(own)
                own[r.randrange(len(own))] = r.choice(marks)  # a chain: neighbours are alike, its ends needn't be
                texts.append(" ".join(own))
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for w in map(str.split, texts)]
    parent = list(range(len(texts)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    alike = [(a, b) for a in range(len(texts)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for a, b in alike:
        parent[root(a)] = root(b)
    want = {frozenset(k for k in range(len(texts)) if root(k) == top) for top in range(len(texts)) if parent[top] == top}
    features = V.chunk_features(spark.createDataFrame([("s", str(k), x, 1, None) for k, x in enumerate(texts)], CHUNKS))

    def groups(family):
        found = {}
        for x in features.join(family, family.columns[0]).collect():
            found.setdefault(x.family, set()).add(int(x.filename))
        return set(map(frozenset, found.values()))

    assert groups(V.families(features)) == want and 12 < len(want) < len(texts)
    assert groups(V.families(features, hot=6)) == want  # buckets in blocks
