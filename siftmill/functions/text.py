"""Text expressions: tokens, trimming, counting, identifiers, chunk splitting. All of them are Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"\p{IsWhite_Space}"
#: Whitespace of regular expressions in the RE2 sense; Java's \s also has the vertical tab.
SPACE = r"[\t\n\f\r ]"
#: What texts are cut at, the first that occurs.
SEPARATORS = ["\n\n", "\n", ". ", " "]
#: Fixed value: a line of a table of contents, 1 to 80 characters and a bare page number.
TOC_LINE = r"(?d)^.{1,80}[\t\n\f\r ]+[0-9]+[\t\n\f\r ]*$"
#: Name spaces of chunk and cache identifiers.
CHUNK_NAMESPACE = "a3b4c5d6-e7f8-4a5b-9c0d-1e2f3a4b5c6d"
CACHE_NAMESPACE = "b1c2d3e4-f5a6-7b8c-9d0e-1f2a3b4c5d6e"


def trim_white(text: Column) -> Column:
    """Without Unicode whitespace at both ends; `trim` takes off U+0020 only."""
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


def fields(text: Column) -> Column:
    """Runs of characters that are not whitespace."""
    return F.filter(F.split(text, f"{WHITE}+"), lambda t: t != "")


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def run_lengths(ordered: Column) -> Column:
    """Structs (first, n) of the runs of equal values of a sorted array without nulls: what it holds, and how often."""
    # Arrays of one bind what is used several times to a name, so that it is found once and not once an element.
    starts = lambda a: F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda k: (k == 0) | (F.get(a, k) != F.get(a, k - 1)))
    runs = lambda a: F.transform(F.array(starts(a)), lambda s: F.transform(s, lambda k, j: F.struct(F.get(a, k).alias("first"), (F.coalesce(F.get(s, j + 1), F.size(a)) - k).alias("n"))))[0]
    return F.transform(F.array(ordered), lambda a: F.when(F.size(a) > 0, runs(a)))[0]


def count_substring(text: Column, part: Column) -> Column:
    """Places where `part` occurs without overlap; an empty part counts as nowhere."""
    return F.when(F.length(part) == 0, 0).otherwise(((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int"))


def term_frequency(query: Column, text: Column) -> Column:
    """Sum over the query's fields of their substring counts; a repeated field counts repeatedly."""
    folded = F.lower(text)
    return F.aggregate(fields(F.lower(query)), F.lit(0.0), lambda acc, t: acc + count_substring(folded, t))


def uuid5(namespace: str, name: Column) -> Column:
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def chunk_id(file_path: Column, line_start: Column, chunk_index: Column) -> Column:
    return uuid5(CHUNK_NAMESPACE, F.concat_ws(":", file_path, line_start, chunk_index))


def section_key(file_path: Column, line_start: Column) -> Column:
    return F.concat_ws(":", file_path, line_start)


def content_sha(content: Column) -> Column:
    """SHA-256 in hex; unreadable (null) content has the empty string."""
    return F.coalesce(F.sha2(content, 256), F.lit(""))


def display_text(window_text: Column, text: Column) -> Column:
    return F.coalesce(F.nullif(window_text, F.lit("")), text)


def contextual_text(file_path: Column, header: Column, text: Column) -> Column:
    return F.concat(file_path, F.when(header != "", F.concat(F.lit(" > "), header)).otherwise(""), F.lit("\n"), text)


def strip_comments(text: Column) -> Column:
    """Without HTML comments that end on the line where they begin."""
    return F.regexp_replace(text, r"(?d)<!--.*?-->", "")


def is_toc(text: Column, threshold: float = 0.6) -> Column:
    """Whether the share of lines that look like a table of contents reaches the threshold; 0 and less never."""
    if threshold <= 0:
        return F.lit(False)
    lines = F.filter(F.transform(F.split(text, "\n"), trim_white), lambda line: line != "")
    hits = F.filter(lines, lambda line: line.rlike(TOC_LINE))
    return (F.size(lines) > 0) & (F.size(hits) / F.size(lines) >= threshold)


def hard_split(text: Column, size: int, overlap: int) -> Column:
    """Pieces of `size` characters that start every size - overlap characters; the last reaches the end."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the size")
    step = size - overlap
    pieces = F.transform(F.sequence(F.lit(0), F.ceil(F.greatest(F.length(text) - size, F.lit(0)) / step).cast("int")), lambda k: F.substring(text, k * step + 1, F.lit(size)))
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(pieces)


def _merge_parts(text: Column, separator: str, size: int, overlap: int) -> Column:
    """Parts joined while they fit; a new piece starts with the last `overlap` characters of the one before and the separator."""
    parts = F.split(text, "\\Q" + separator + "\\E", -1)

    def add(acc: Column, part: Column) -> Column:
        now = acc["now"]
        fits = (F.length(now) == 0) | (F.length(now) + len(separator) + F.length(part) <= size)
        joined = F.when(F.length(now) == 0, part).otherwise(F.concat(now, F.lit(separator), part))
        tail = F.right(now, F.lit(overlap)) if overlap else F.lit("")
        fresh = F.concat(tail, F.lit(separator), part)
        return F.when(fits, F.struct(acc["done"].alias("done"), joined.alias("now"))).otherwise(F.struct(F.concat(acc["done"], F.array(now)).alias("done"), fresh.alias("now")))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    return F.aggregate(parts, start, add, lambda acc: F.when(F.length(acc["now"]) == 0, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))))


def recursive_chunks(text: Column, size: int = 512, overlap: int = 64) -> Column:
    """The text if it fits; else its parts by the first separator that occurs, merged; else hard pieces. Pieces are trimmed."""
    chosen = F.when(F.length(text) <= size, F.array(text))
    for separator in SEPARATORS:
        chosen = chosen.when(F.contains(text, F.lit(separator)), _merge_parts(text, separator, size, overlap))
    return F.filter(F.transform(chosen.otherwise(hard_split(text, size, overlap)), trim_white), lambda x: x != "")


def sentences(text: Column) -> Column:
    """Sentences with their closing marks: cut at whitespace behind . ! or ?"""
    return F.filter(F.transform(F.split(text, f"(?<=[.!?]){SPACE}+"), trim_white), lambda s: s != "")


def sentence_windows(text: Column, width: int = 2) -> Column:
    """Structs (text, window_text): each sentence, and it with up to `width` neighbours on both sides."""
    # An array of one binds the sentences to a name, so that they are found once and not once a sentence.
    each = lambda found: F.transform(found, lambda s, i: F.struct(s.alias("text"), F.array_join(F.slice(found, F.greatest(i - width, F.lit(0)) + 1, F.least(i, F.lit(width)) + 1 + width), " ").alias("window_text")))
    return F.transform(F.array(sentences(text)), each)[0]


def fragments(query: Column) -> Column:
    """The query's parts between runs of . ? and ;, or the query itself if none is left."""
    parts = F.filter(F.transform(F.split(query, rf"[.?;]+{SPACE}*"), trim_white), lambda p: p != "")
    return F.when(F.size(parts) == 0, F.array(query)).otherwise(parts)


def clip_utf8(text: Column, n_bytes: Column) -> Column:
    """The longest run of whole characters from the start that has at most `n_bytes` UTF-8 bytes."""
    raw = F.encode(text, "UTF-8")
    # A byte 0x80-0xBF behind the cut belongs to the character before it: step back to that character's start.
    ends = F.aggregate(F.sequence(F.lit(0), F.lit(3)), F.greatest(n_bytes, F.lit(0)).cast("int"), lambda acc, _: F.when((acc > 0) & (acc < F.octet_length(text)) & (F.conv(F.hex(F.substring(raw, acc + 1, F.lit(1))), 16, 10).cast("int").between(128, 191)), acc - 1).otherwise(acc))
    return F.when(F.octet_length(text) <= n_bytes, text).otherwise(F.decode(F.substring(raw, F.lit(1), ends), "UTF-8"))


def middle_order(n: Column, i: Column) -> Column:
    """Place of item i of n when the best stand at both ends: even ones from the front, odd ones from the back."""
    return F.when(n <= 2, i).when(i % 2 == 0, (i / 2).cast("int")).otherwise(n - 1 - ((i - 1) / 2).cast("int"))


def ndjson_text(stream: Column) -> Column:
    """The concatenated message contents of newline-separated JSON; bad lines are skipped, `done` ends the stream."""
    lines = F.filter(F.split(stream, "\n"), lambda x: trim_white(x) != "")
    parsed = F.filter(F.transform(lines, lambda x: F.from_json(x, "message struct<role:string,content:string>, done boolean")), lambda x: x.isNotNull())
    end = F.array_position(F.transform(parsed, lambda x: F.coalesce(x["done"], F.lit(False))), True)
    upto = F.when(end > 0, F.slice(parsed, 1, end.cast("int"))).otherwise(parsed)
    return F.array_join(F.transform(upto, lambda x: F.coalesce(x["message"]["content"], F.lit(""))), "")


def filter_scores(reply: Column) -> Column:
    """The array of numbers in a model's reply, with or without a code fence; null where it does not parse."""
    bare = F.regexp_replace(F.regexp_replace(trim_white(reply), r"^```(?:json)?", ""), r"```$", "")
    return F.from_json(trim_white(bare), "array<double>")
