"""Spelling variants: words one edit apart, found with forward and backward minimal acyclic automata.

If two words differ by one edit, the edit lies in the second or in the first half of the word that is looked up. In the first case
the half before it is matched exactly by an automaton of the dictionary, which then completes the word with one error; in
the second case the same is done from the end, with an automaton of the reversed words. States carry the number of words
behind them, so that a path adds up to the number of its word (perfect hashing) and words are found in arrays.

Words that agree in a half meet in a bucket by that half, and every bucket has an automaton of its own. A half that many
words share is cut into slices of the dictionary, and what is looked up goes to all of them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.llm.common import durable, small

#: Entries after which a task hands on the counts that it has gathered.
MOST_COUNTS = 200_000
#: Words that a bucket, and a slice of a half that many words share, should have at most.
BUCKET_WORDS, SLICE_WORDS = 20_000, 20_000
LETTERS = "A-Za-zÀ-ÿ"
#: Only A-Z are folded.
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})


# ---------------------------------------------------------------- words


def count_words(docs: DataFrame, least_length: int = 6, drop_every: int = 199, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: how often the words of all texts occur.

    A word is a maximal run of Latin-1 letters (with the two signs among them), A-Z folded; where `drop_every` divides the
    CRC-32 h of `<key>:<run>`, the code point at h modulo its length is left out. Results shorter than `least_length` are not
    counted. A null key is empty in this text; a null text has no words. A task counts what it reads before anything is
    shuffled, in a table of bounded size.
    """
    runs = re.compile(f"[{LETTERS}]{{{least_length},}}").findall  # a shorter run gives nothing, with or without a letter less

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not (t := t.as_py()):
                    continue
                head = zlib.crc32(f"{'' if k is None else k}:".encode())
                for run, n in Counter(runs(t.translate(FOLD))).items():
                    h = zlib.crc32(run.encode(), head)
                    if h % drop_every == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < least_length:
                            continue
                    counts[run] += n
                if len(counts) >= MOST_COUNTS:
                    yield handed()
        yield handed()

    found = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(each, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- automata


class Automaton:
    """A minimal acyclic automaton of sorted distinct words, whose paths add up to the words' numbers.

    `edges[s]` maps a character to the next state, `before[s]` to the number of words that state s accepts through smaller
    characters or by ending. `final[s]` tells whether a word ends at s.
    """

    def __init__(self, words: list[str]):
        self.edges: list[dict[str, int]] = [{}]
        self.final = [False]
        known: dict[tuple, int] = {}
        path, last = [0], ""

        def settle(upto: int) -> None:
            # States behind the common prefix get no more edges: an equal one that is known stands for each.
            while len(path) > upto + 1:
                state = path.pop()
                sign = (self.final[state], *self.edges[state].items())
                if (same := known.setdefault(sign, state)) != state:
                    self.edges[path[-1]][last[len(path) - 1]] = same
                    free.append(state)

        free: list[int] = []
        for word in words:
            common = 0
            for a, b in zip(word, last):  # noqa: B905
                if a != b:
                    break
                common += 1
            settle(common)
            for c in word[common:]:
                if free:
                    state = free.pop()
                    self.edges[state], self.final[state] = {}, False
                else:
                    state = len(self.edges)
                    self.edges.append({})
                    self.final.append(False)
                self.edges[path[-1]][c] = state
                path.append(state)
            self.final[path[-1]] = True
            last = word
        settle(0)
        self._number()

    def _number(self) -> None:
        n = len(self.edges)
        size, order, seen, stack = [0] * n, [], [False] * n, [0]
        while stack:
            state = stack.pop()
            if state < 0:
                order.append(~state)
            elif not seen[state]:
                seen[state] = True
                stack.append(~state)
                stack += [t for t in self.edges[state].values() if not seen[t]]
        self.before: list[dict[str, int]] = [{} for _ in range(n)]
        for state in order:
            total = int(self.final[state])
            for c in sorted(self.edges[state]):
                self.before[state][c] = total
                total += size[self.edges[state][c]]
            size[state] = total
        self.size = size

    def walk(self, word: str, start: int = 0, state: int = 0, number: int = 0) -> tuple[int, int] | None:
        """State and number behind word[start:]."""
        for c in word[start:]:
            to = self.edges[state].get(c)
            if to is None:
                return None
            number += self.before[state][c]
            state = to
        return state, number

    def one_error(self, word: str, half: int) -> Iterator[int]:
        """Numbers of the words that agree with the first `half` characters and differ behind them by one edit.

        A number may come more than once.
        """
        at = self.walk(word[:half])
        if at is None:
            return
        state, number = at
        for k in range(half, len(word) + 1):
            edges, before = self.edges[state], self.before[state]
            here = word[k] if k < len(word) else ""
            for c, to in edges.items():
                past = number + before[c]
                # The word lacks c here.
                if (end := self.walk(word, k, to, past)) and self.final[end[0]]:
                    yield end[1]
                # The word has another character here.
                if here and c != here and (end := self.walk(word, k + 1, to, past)) and self.final[end[0]]:
                    yield end[1]
            # The word has one character too many.
            if here and (end := self.walk(word, k + 1, state, number)) and self.final[end[0]]:
                yield end[1]
            to = edges.get(here)
            if to is None:
                return
            number += before[here]
            state = to


def near_in(words: list[str], asked: list[tuple[str, int]], backward: bool) -> Iterator[tuple[int, int]]:
    """(place in `asked`, place in `words`) of words one edit apart, the edit behind the half that is asked for.

    words: distinct, in any order; asked: words with the length of the half, reversed here if `backward`.
    """
    turned = [w[::-1] for w in words] if backward else words
    order = sorted(range(len(turned)), key=turned.__getitem__)
    automaton = Automaton([turned[k] for k in order])
    for k, (word, half) in enumerate(asked):
        for number in set(automaton.one_error(word[::-1] if backward else word, half)):
            yield k, order[number]


# ---------------------------------------------------------------- tables


def halves(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The keys (direction, half) by which words meet: those of the dictionary and those that are looked up.

    A word of n code points is looked up by its first n // 2 code points (direction 0) and by the last n - n // 2 (direction
    1). Its partners have a code point more or less, so that a word stands in the dictionary under the halves of all three
    lengths, two a direction.
    """
    n = F.length("word")
    first, rest = lambda m: F.floor(m / 2).cast("int"), lambda m: (m - F.floor(m / 2)).cast("int")
    key = lambda d, half: F.struct(F.lit(d).alias("d"), half.alias("half"))
    front = F.array_distinct(F.array(*(F.substring("word", F.lit(1), first(n + k)) for k in (-1, 0, 1))))
    back = F.array_distinct(F.array(*(F.right("word", F.least(rest(n + k), n)) for k in (-1, 0, 1))))
    stand = F.concat(F.transform(front, lambda x: key(0, x)), F.transform(back, lambda x: key(1, x)))
    ask = F.array(key(0, F.substring("word", F.lit(1), first(n))), key(1, F.right("word", rest(n))))
    return words.select("word", "n", F.inline(stand)), words.select("word", "n", F.inline(ask))


def near_words(words: DataFrame, bucket_words: int = BUCKET_WORDS, slice_words: int = SLICE_WORDS) -> DataFrame:
    """word, near, near_n: the words that differ from each word by exactly one inserted, deleted or replaced code point.

    words: word, n; distinct, at least two code points each. A pair found from both ends is returned once in each
    direction. Halves shared by more than `slice_words` words are cut into slices, so that no bucket grows with them.
    """
    stand, ask = halves(words)
    many = stand.groupBy("d", "half").count().where(F.col("count") > slice_words)
    cut = small(many.select("d", "half", F.ceil(F.col("count") / slice_words).cast("int").alias("slices")))
    slices = F.coalesce("slices", F.lit(1))
    stand = stand.join(cut, ["d", "half"], "left").select("d", "half", "word", "n", F.pmod(F.xxhash64("word"), slices).cast("int").alias("slice"), F.lit(False).alias("asks"))
    ask = ask.join(cut, ["d", "half"], "left").select("d", "half", "word", "n", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"), F.lit(True).alias("asks"))
    buckets = max(1, -(-6 * words.count() // bucket_words))
    met = stand.unionByName(ask).select("d", F.pmod(F.xxhash64("half", "slice"), F.lit(buckets)).alias("bucket"), F.length("half").alias("size"), "word", "n", "asks")

    def each(table: pa.Table) -> pa.Table:
        cols = {c: table.column(c).to_pylist() for c in ("d", "size", "word", "n", "asks")}
        backward = cols["d"][0] == 1
        held = {w: n for w, n, a in zip(cols["word"], cols["n"], cols["asks"], strict=True) if not a}
        asked = [(w, s) for w, s, a in zip(cols["word"], cols["size"], cols["asks"], strict=True) if a]
        words = list(held)
        pairs = list(near_in(words, asked, backward)) if words else []
        return pa.table({"word": pa.array([asked[a][0] for a, _ in pairs], pa.string()), "near": pa.array([words[b] for _, b in pairs], pa.string()), "near_n": pa.array([held[words[b]] for _, b in pairs], pa.int64())})

    found = met.groupBy("d", "bucket").applyInArrow(each, "word string, near string, near_n long")
    return found.dropDuplicates(["word", "near"])


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last word on the way from form to form. forms: word, form; no cycles.

    Every round doubles the steps that are taken, so that their number is the logarithm of the longest way.
    """
    at = durable(forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        stepped = durable(at.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        at = stepped.select("word", "root")
        if not stepped.where("_moved").limit(1).count():
            return at


def spelling_variants(docs: DataFrame, least_length: int = 6, least_n: int = 5, ratio: int = 5, drop_every: int = 199, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of at least `least_length` code points and `least_n` occurrences.

    form: the near word that occurs most (ties: the first in code-point order), if it occurs `ratio` times as often as the
    word; root: where following the forms ends, the word itself if it has none. Words, null keys and null texts are those of
    `count_words`; repeated rows count as often as they occur; very long texts and words are taken whole. An empty table
    gives no rows; other columns are left out.
    """
    words = durable(count_words(docs, least_length, drop_every, key, text).where(F.col("n") >= least_n))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("form"))).alias("_best"))
    best = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("_best.n") >= ratio * F.col("n"), F.col("_best")).alias("_form"))
    formed = durable(best.select("word", "n", "n_near", F.col("_form.form").alias("form"), (-F.col("_form.n")).alias("form_n")))
    last = roots(formed.where("form is not null").select("word", "form"))
    return formed.join(last, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
