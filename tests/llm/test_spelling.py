"""Spelling variants against brute force over all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from siftmill.llm import spelling as sp


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(rows, least=6, often=5, every=199):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least and n >= often}
    out = {}
    for w, n in words.items():
        near = [(-words[v], v) for v in words if one_edit(w, v)]
        best = min(near) if near else (0, None)
        form = best[1] if near and -best[0] >= 5 * n else None
        out[w] = [n, len(near), form, words[form] if form else None]
    for w, row in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        row.append(root)
    return {(w, *row) for w, row in out.items()}


def words_of(seed, n, letters="abcé", low=6, high=9):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(low, high))) for _ in range(n)]


def test_automaton_numbers_words_in_order_and_shares_endings():
    words = sorted(set(words_of(1, 300)))
    a = sp.Automaton(words)
    assert [a.walk(w)[1] for w in words] == list(range(len(words)))
    assert all(a.final[a.walk(w)[0]] for w in words)
    assert a.walk(words[0] + "x") is None
    assert sum(n > 0 for n in sp.Automaton(["abxyz", "cdxyz"]).size) == 7


@pytest.mark.parametrize("backward", [False, True])
def test_one_error_behind_the_half(backward):
    words = list(dict.fromkeys(words_of(2, 400, "abc", 2, 6)))
    asked = [(w, len(w) // 2) for w in words[:150]] + [("zz", 1), ("a", 0), ("", 0)]
    got = {(asked[a][0], words[b]) for a, b in sp.near_in(words, asked, backward)}
    turn = (lambda w: w[::-1]) if backward else (lambda w: w)
    want = {(q, v) for q, half in asked for v in words if turn(v)[:half] == turn(q)[:half] and one_edit(turn(q)[half:], turn(v)[half:])}
    assert got == want


@pytest.mark.parametrize("sizes", [(20_000, 20_000), (50, 7)])
def test_near_words_find_every_pair_once(spark, sizes):
    words = sorted({*words_of(3, 500, "ab", 6, 9), "aaaaaa", "aaaaaaa", "öaaaaa"})
    got = sp.near_words(spark.createDataFrame([(w, k) for k, w in enumerate(words)], "word string, n long"), *sizes).collect()
    assert sorted((r.word, r.near) for r in got) == sorted((a, b) for a in words for b in words if one_edit(a, b))
    assert all(words[r.near_n] == r.near for r in got)


def test_variants_equal_brute_force(spark):
    rng = random.Random(4)
    pool = words_of(5, 60, "abcé", 5, 8) + ["Übermäßig", "ubermäßig", "x×y÷zzz", "LONGEST" * 3]
    weights = [rng.choice([1, 1, 2, 30]) for _ in pool]
    rows = [(rng.choice([None, 1, 2, k]), " ".join(rng.choices(pool, weights, k=80)) + "1é\n") for k in range(60)]
    rows += [(3, None), (4, ""), (None, None), (5, "tiny"), (6, "abcabc " * 9000), (6, "abcabc " * 9000), (7, "q" * 100_000 + " "), *((k, "mmmmmm mmmmmn " + "mmmmmn mmmmnn " * 8 + "mmmmnn " * 60) for k in range(100, 106))]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, word string, n int").repartition(4)
    got = {tuple(r) for r in sp.spelling_variants(docs, drop_every=19).collect()}
    assert got == plain_variants(rows, every=19)
    assert any(r[3] for r in got) and any(r[3] and r[5] != r[3] for r in got)


def test_roots_follow_long_ways(spark):
    way = [(f"w{k}", f"w{k + 1}") for k in range(13)] + [("v", "w3")]
    assert {tuple(r) for r in sp.roots(spark.createDataFrame(way, "word string, form string")).collect()} == {(w, "w13") for w, _ in way}


def test_empty_table_and_bounded_counts(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "abcdef ghijkl")] * 20, "doc_id long, text string")
    assert sp.spelling_variants(docs.limit(0)).collect() == []
    monkeypatch.setattr(sp, "MOST_COUNTS", 1)
    assert {(r.word, r.n) for r in sp.count_words(docs).collect()} == {("abcdef", 20), ("ghijkl", 20)}
