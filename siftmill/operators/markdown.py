"""Sections of markdown documents: a line scanner for the block structure, and plain text of its blocks.

The scanner knows what decides about sections: headings of both kinds, paragraphs, lists, block quotes, fenced and
indented code, HTML blocks and rules. It runs as a batch function over texts; chunking of the sections is built from
Column functions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.functions import text as tx

SECTIONS = "array<struct<header:string,line_start:int,text:string>>"

_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_FENCE = re.compile(r"( {0,3})(`{3,}(?=[^`]*$)|~{3,})")
_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])(?:([ \t]+)(.*)|[ \t]*$)")
_QUOTE = re.compile(r" {0,3}> ?")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_HTML = re.compile(r" {0,3}<(?:!--|\?|![A-Za-z]|!\[CDATA\[|/?(?:address|article|aside|blockquote|body|br|center|dd|details|dialog|dir|div|dl|dt|fieldset|figure|footer|form|frame|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|nav|ol|option|p|param|pre|script|section|style|summary|table|tbody|td|textarea|tfoot|th|thead|title|tr|track|ul)(?:[\s/>]|$))", re.I)
_SPAN = re.compile(
    r"""(?P<tick>`+)(?P<code>.+?)(?<!`)(?P=tick)(?!`)     # code span
    |!?\[(?P<label>(?:[^\[\]\\]|\\.|\[[^\[\]]*\])*)\]\((?:[^()\\]|\\.|\([^()]*\))*\)  # link or image
    |(?P<auto><(?:[a-zA-Z][a-zA-Z0-9+.-]{1,31}:[^\s<>]*|[^\s<>@]+@[^\s<>]+|/?[a-zA-Z][^<>]*|!--.*?--)>)
    |(?P<strong>\*\*|__)(?=\S)(?P<bold>.+?)(?<=\S)(?P=strong)
    |(?<![\w*])(?P<mark>[*_])(?=[^\s*_])(?P<em>[^*_]+?)(?<=[^\s*_])(?P=mark)(?!\w)
    """,
    re.X | re.S,
)


def inline_text(text: str) -> str:
    """Text without marks: labels of links and images, contents of code spans; raw tags and autolinks vanish."""

    def plain(m: re.Match) -> str:
        if m["code"] is not None:
            code = m["code"].replace("\n", " ")
            return code[1:-1] if len(code) > 2 and code[0] == code[-1] == " " and code.strip() else code
        if m["auto"] is not None:
            return ""
        return inline_text(next(x for x in (m["label"], m["bold"], m["em"]) if x is not None))

    return _SPAN.sub(plain, text)


def _paragraph(lines: list[str]) -> str:
    body = "\n".join(x.strip(" \t") if k == len(lines) - 1 else re.sub(r"(?:[ \t]+|\\)$", "", x.lstrip(" \t")) for k, x in enumerate(lines))
    return inline_text(body).replace("\n", " ")


def _opens(line: str, in_paragraph: bool) -> bool:
    """Whether the line begins a block that ends a paragraph."""
    item = _ITEM.match(line)
    if item and in_paragraph and (not (item[4] or "").strip() or (item[2][0].isdigit() and item[2] not in ("1.", "1)"))):
        item = None
    return bool(item or _ATX.match(line) or _RULE.match(line) or _FENCE.match(line) or _QUOTE.match(line) or (_HTML.match(line)))


def _blocks(lines: list[str]) -> Iterator[tuple[str, int, str]]:
    """(kind, index of the first line, text) of the top-level blocks."""
    k = 0
    while k < len(lines):
        line = lines[k]
        if not line.strip(" \t"):
            k += 1
            continue
        fence, head = _FENCE.match(line), _ATX.match(line)
        if re.match(r"(?: {4}| {0,3}\t)", line):
            start = k
            while k < len(lines) and (not lines[k].strip() or re.match(r"(?: {4}| {0,3}\t)", lines[k])):
                k += 1
            yield "code", start, "".join(x[4:] + "\n" for x in lines[start:k])
        elif fence:
            start, k, body = k, k + 1, []
            while k < len(lines) and not re.match(rf" {{0,3}}{re.escape(fence[2][0])}{{{len(fence[2])},}}[ \t]*$", lines[k]):
                body.append(re.sub(rf"^ {{0,{len(fence[1])}}}", "", lines[k]))
                k += 1
            k += 1
            yield "code", start, "".join(x + "\n" for x in body)
        elif head:
            yield "heading", k, inline_text((head[2] or "").strip(" \t"))
            k += 1
        elif _RULE.match(line):
            yield "rule", k, ""
            k += 1
        elif _QUOTE.match(line):
            start, inner, lazy = k, [], False
            while k < len(lines):
                if _QUOTE.match(lines[k]):
                    inner.append(_QUOTE.sub("", lines[k], count=1))
                    lazy = bool(inner[-1].strip()) and not _opens(inner[-1], False)
                elif lazy and lines[k].strip() and not _opens(lines[k], True):
                    inner.append(lines[k])
                else:
                    break
                k += 1
            yield "quote", start, _nested(inner)
        elif (item := _ITEM.match(line)) is not None:
            start = k
            kind, text = item[2][-1], []
            while k < len(lines) and (now := _ITEM.match(lines[k])) and now[2][-1] == kind and not _RULE.match(lines[k]):
                gap = len(now[3] or " ")
                indent = len(now[1]) + len(now[2]) + (gap if gap <= 4 and (now[4] or "").strip() else 1)
                inner = [(now[4] or "") if gap <= 4 else " " * (gap - 1) + (now[4] or "")]
                k += 1
                while k < len(lines):
                    if not lines[k].strip():
                        if k + 1 < len(lines) and (not lines[k + 1].strip() or len(lines[k + 1]) - len(lines[k + 1].lstrip(" ")) >= indent):
                            inner.append("")
                        elif k + 1 < len(lines) and (nxt := _ITEM.match(lines[k + 1])) and nxt[2][-1] == kind:
                            k += 1
                            break
                        else:
                            break
                    elif len(lines[k]) - len(lines[k].lstrip(" ")) >= indent:
                        inner.append(lines[k][indent:])
                    elif inner[-1].strip() and not _ITEM.match(lines[k]) and not _opens(lines[k], True) and not _SETEXT.match(lines[k]):
                        inner.append(lines[k].lstrip())
                    else:
                        break
                    k += 1
                text.append(_nested(inner))
                if k < len(lines) and not lines[k].strip():
                    break
            yield "list", start, "".join(text)
        elif _HTML.match(line):
            start = k
            comment = re.match(r" {0,3}<!--", line)
            while k < len(lines) and (("-->" not in lines[k]) if comment else lines[k].strip()):
                k += 1
            k += 1 if comment else 0
            yield "html", start, ""
        else:
            start, body = k, [line]
            k += 1
            done = False
            while k < len(lines) and lines[k].strip():
                if _SETEXT.match(lines[k]):
                    yield "heading", start, _paragraph(body)
                    k, done = k + 1, True
                    break
                if _opens(lines[k], True):
                    break
                body.append(lines[k])
                k += 1
            if not done:
                yield "paragraph", start, _paragraph(body)


def _nested(lines: list[str]) -> str:
    return "".join(text for kind, _, text in _blocks(lines) if kind in ("paragraph", "list", "quote", "code", "heading"))


def sections(text: str) -> list[tuple[str, int, str]]:
    """(header, first line from 1, text) of the sections under each heading.

    Paragraphs, lists and quotes give a line of text each; top-level code, HTML and rules give none. Sections without
    text are left out, and a document without any section is one as a whole.
    """
    lines = re.split(r"\r\n|\n|\r", text)
    out: list[tuple[str, int, str]] = []
    header, at, body = "", 1, []
    for kind, first, content in _blocks(lines):
        if kind == "heading":
            if body:
                out.append((header, at, "\n".join(body)))
            header, body = content.strip(), []
            if header:
                at = first + 1
        elif kind in ("paragraph", "list", "quote"):
            body.append(content)
    if body:
        out.append((header, at, "\n".join(body)))
    return out or [("", 1, text)]


def section_column(text: Column) -> Column:
    """Sections of a text column, batch by batch; null has none."""

    @F.pandas_udf(SECTIONS)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: [] if t is None else [{"header": h, "line_start": n, "text": s} for h, n, s in sections(t)])

    return found(text)


def chunk_documents(docs: DataFrame, strategy: str = "recursive", size: int = 512, overlap: int = 64, window: int = 2, toc_threshold: float = 0.6) -> DataFrame:
    """Chunks of (file_path, text, ...): chunk_id, file_path, header, line_start, chunk_index, text, window_text.

    The recursive strategy removes comments, splits sections and leaves out tables of contents; the sentence window
    strategy gives a row for each sentence with its neighbours. Ordinals count within a section, without gaps.
    """
    keep = [c for c in docs.columns if c not in ("text", "file_path")]
    source = tx.strip_comments(F.col("text")) if strategy == "recursive" else F.col("text")
    parts = docs.select("file_path", *keep, F.inline(section_column(source)))
    if strategy == "recursive":
        pieces = F.filter(tx.recursive_chunks(F.col("text"), size, overlap), lambda c: ~tx.is_toc(c, toc_threshold))
        rows = parts.select("file_path", *keep, "header", "line_start", F.posexplode(F.transform(pieces, lambda c: F.struct(c.alias("text"), F.lit("").alias("window_text")))).alias("chunk_index", "_c"))
    else:
        rows = parts.select("file_path", *keep, "header", "line_start", F.posexplode(tx.sentence_windows(F.col("text"), window)).alias("chunk_index", "_c"))
    named = rows.select("file_path", *keep, "header", "line_start", "chunk_index", "_c.text", "_c.window_text")
    return named.withColumn("chunk_id", tx.chunk_id(F.col("file_path"), F.col("line_start"), F.col("chunk_index")))
