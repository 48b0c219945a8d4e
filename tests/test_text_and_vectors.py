"""Golden cases of text and vector expressions."""

import math
import uuid

import pytest
from pyspark.sql import functions as F

from siftmill.functions import text as tx
from siftmill.functions import vectors as vx
from siftmill.operators.markdown import chunk_documents, sections
from siftmill.sources.files import distinct_roots, glob_regex, ignored

GLOB_CASES = [
    ("drafts/**", "drafts/2024/may/plan.md", True),
    ("drafts/**", "drafts/", True),
    ("drafts/**", "drafts", False),
    ("drafts/**", "team/drafts/plan.md", False),
    ("drafts/**", "draftsman/plan.md", False),
    ("a.b/**", "axb/c.md", False),
    ("NOTICE.md", "NOTICE.md", True),
    ("NOTICE.md", "old/NOTICE.md", False),
    ("NOTICE.md", "notice.md", False),
    ("*.draft.md", "plan.draft.md", True),
    ("*.draft.md", "draft.md", False),
    ("*.draft.md", "x/plan.draft.md", False),
    ("v?/log.md", "v1/log.md", True),
    ("v?/log.md", "v12/log.md", False),
    ("part[0-9].md", "part7.md", True),
    ("part[^0-9].md", "part7.md", False),
    ("part[^0-9].md", "partx.md", True),
    ("plain\\*.md", "plain*.md", True),
    ("plain\\*.md", "plainer.md", False),
    ("*/index.md", "guide/index.md", True),
    ("*/index.md", "guide/en/index.md", False),
    ("open[", "open[", False),
]


def one(spark, expression, **columns):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()] or [F.lit(1).alias("_")])
    return row.select(expression.alias("r")).first()["r"]


def test_sections():
    assert sections("# A\n\nx\ny\n\n# B\n\n# C\n\nz") == [("A", 1, "x y"), ("C", 8, "z")]
    assert sections("- a\n- b") == [("", 1, "ab")] and sections("> p\n> q") == [("", 1, "p q")]
    assert sections("```\ncode\n```") == [("", 1, "```\ncode\n```")]
    assert sections("see [lbl](u) ![alt](i) `c` ") == [("", 1, "see lbl alt c")]
    assert sections("T\n==\n\n1. x\n2. y\n\n***\n\ntail") == [("T", 1, "xy\ntail")]
    assert sections("a\n\n<div>\nhtml\n</div>\n\n    code\n\nb") == [("", 1, "a\nb")]
    assert sections("> # no section\n\ntext") == [("", 1, "no section\ntext")]
    assert sections("") == [("", 1, "")]


def test_chunks(spark):
    chunk = lambda t, n, o: one(spark, tx.recursive_chunks(F.col("t"), n, o), t=t)
    assert chunk("aaaa. bbbb. cccc. dddd", 10, 3) == ["aaaa. bbbb", "bbb. cccc", "ccc. dddd"]
    assert chunk("abcdefghij", 4, 1) == ["abcd", "defg", "ghij"]
    assert chunk("short", 10, 2) == ["short"] and chunk("  ", 10, 2) == [] and chunk("", 10, 2) == []
    with pytest.raises(ValueError):
        tx.hard_split(F.lit("x"), 4, 4)
    got = one(spark, tx.sentence_windows(F.lit("A. B! C?"), 1))
    assert [(r["text"], r["window_text"]) for r in got] == [("A.", "A. B!"), ("B!", "A. B! C?"), ("C?", "B! C?")]
    assert one(spark, tx.fragments(F.lit("v1.2; a? b"))) == ["v1", "2", "a", "b"]
    assert one(spark, tx.fragments(F.lit("?"))) == ["?"] and one(spark, tx.fragments(F.lit("hi! yo"))) == ["hi! yo"]


def test_chunk_documents(spark):
    docs = spark.createDataFrame([("a.md", "# H\n\nOne. Two. <!-- gone -->\n\n- x\n- y\n\n# Toc\n\nIntro 1\n\nNext 22\n"), ("e.md", ""), ("n.md", None)], "file_path string, text string")
    got = {(r["file_path"], r["header"], r["line_start"], r["chunk_index"]): r["text"] for r in chunk_documents(docs, size=100, overlap=10).collect()}
    assert got == {("a.md", "H", 1, 0): "One. Two.\nxy"}
    rows = chunk_documents(docs, "sentence_window", window=1).where("header = 'H'").orderBy("chunk_index").collect()
    assert [(r["text"], r["window_text"]) for r in rows][:2] == [("One.", "One. Two."), ("Two.", "One. Two. xy")]
    ns = uuid.UUID(tx.CHUNK_NAMESPACE)
    assert all(r["chunk_id"] == str(uuid.uuid5(ns, f"{r['file_path']}:{r['line_start']}:{r['chunk_index']}")) for r in chunk_documents(docs).collect())


def test_text_helpers(spark):
    assert one(spark, tx.trim_white(F.lit("  \t x y\n"))) == "x y"
    assert one(spark, tx.uuid5(tx.CACHE_NAMESPACE, F.lit("grüße"))) == str(uuid.uuid5(uuid.UUID(tx.CACHE_NAMESPACE), "grüße"))
    assert one(spark, tx.term_frequency(F.lit("Cat cat dog"), F.lit("concatenate the CAT"))) == 4.0
    assert one(spark, tx.strip_comments(F.lit("a<!-- x -->b<!-- y\n-->c"))) == "ab<!-- y\n-->c"
    assert one(spark, tx.contextual_text(F.lit("f"), F.lit(""), F.lit("t"))) == "f\nt" and one(spark, tx.contextual_text(F.lit("f"), F.lit("h"), F.lit("t"))) == "f > h\nt"
    assert one(spark, tx.display_text(F.lit(""), F.lit("t"))) == "t" and one(spark, tx.display_text(F.lit("w"), F.lit("t"))) == "w"
    for n in range(12):
        want = "aéß€😀z".encode()[:n].decode("utf-8", "ignore")
        assert one(spark, tx.clip_utf8(F.lit("aéß€😀z"), F.lit(n))) == want
    assert one(spark, tx.content_sha(F.lit(None).cast("binary"))) == ""
    for n, want in ((5, [0, 4, 1, 3, 2]), (6, [0, 5, 1, 4, 2, 3]), (2, [0, 1]), (1, [0])):
        assert [one(spark, tx.middle_order(F.lit(n), F.lit(i))) for i in range(n)] == want
    assert one(spark, tx.filter_scores(F.lit("```json\n[0.5, 1]\n```"))) == [0.5, 1.0] and one(spark, tx.filter_scores(F.lit("no"))) is None


def test_vectors(spark):
    arr = lambda *v: F.array(*map(F.lit, v)).cast("array<float>")
    assert [round(x, 6) for x in one(spark, vx.l2_normalize(arr(3.0, 4.0)))] == [0.6, 0.8] and one(spark, vx.l2_normalize(arr(0.0, 0.0))) == [0.0, 0.0]
    assert one(spark, vx.cosine(arr(0.0), arr(1.0))) is None and math.isclose(one(spark, vx.cosine(arr(1.0, 1.0), arr(1.0, 0.0))), 2**-0.5)
    ints = lambda *v: F.array(*map(F.lit, v)).cast("array<long>")
    assert one(spark, vx.sparse_dot(ints(1, 2, 9), arr(1.0, 2.0, 3.0), ints(2, 2, 1), arr(5.0, 7.0, 1.0))) == 15.0
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 0.0])], "g long, v array<float>")
    got = {r["g"]: [round(x, 4) for x in r["vector"]] for r in vx.mean_vectors(rows, "g", "v").collect()}
    assert got == {1: [0.7071, 0.7071], 2: [1.0, 0.0]}


def test_globs(spark):
    rows = spark.createDataFrame([(k, p) for k, (_, p, _) in enumerate(GLOB_CASES)], "k long, path string")
    for k, (pattern, path, want) in enumerate(GLOB_CASES):
        assert rows.where(f"k = {k}").select(F.col("path").rlike(glob_regex(pattern) or "(?!)").alias("r")).first()["r"] is want, (pattern, path)
    assert glob_regex("[") is None and glob_regex("a\\") is None
    paths = spark.createDataFrame([("docs/a.md",), ("node_modules/x/y.md",), ("a/CLAUDE.md",), ("CLAUDE.md",), ("x/y/z.md",)], "p string")
    kept = {r["p"] for r in paths.where(~ignored(F.col("p"), ["node_modules/**", "CLAUDE.md", "x/*/", "["])).collect()}
    assert kept == {"docs/a.md", "a/CLAUDE.md"}
    assert distinct_roots("b", "", None, "a", "b") == ["b", "a"]
