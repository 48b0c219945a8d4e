"""Brute-force comparisons and edge cases of the operators."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftmill.llm import common, decontaminate, licenses, lm, media, mixing, near_dedup, quality, sharding, substrings, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, size string, id string, block string"


def frame(spark, texts, sources=None, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", sources[i] if sources else "s", len(t or ""), "x", "y", "z", "w") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def words(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0d]+", folded)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgéß") for _ in range(rng.randint(1, 6))) for _ in range(120)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 160))) for _ in range(30)]
    out = list(base)
    for t in base[:12]:
        w = t.split(" ")
        for k in range(rng.randint(1, 3)):
            w[rng.randrange(len(w))] = "Edit" + str(k)
        out.append(" ".join(w))
    passage = base[0][:90]
    out += [f"{t[:40]} {passage} {t[60:]}" for t in base[12:20]]
    out += [base[1], base[1], base[1].upper(), None, "", "   \t\n", "one", "One ", "aaaa " * 60, "a" * 200, "a" * 49, "a" * 50, "x\x00y " * 30]
    return out


def brute_repeats(texts, ids, length):
    smallest = {}
    data = {i: (t or "").encode() for i, t in zip(ids, texts, strict=True)}
    for i in sorted(data):
        for p in range(len(data[i]) - length + 1):
            smallest.setdefault(data[i][p : p + length], i)
    out = {}
    for i, body in data.items():
        hit = bytearray(len(body))
        for p in range(len(body) - length + 1):
            if smallest[body[p : p + length]] < i:
                hit[p : p + length] = b"\1" * length
        kept = bytes(b for b, h in zip(body, hit, strict=True) if not h)
        out[i] = (len(body), sum(hit), len(re.findall(rb"\x01+", bytes(hit))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("length,block", [(50, 1 << 20), (50, 1500), (21, 1500), (120, 3000)])
def test_repeats_equal_brute_force(spark, texts, length, block):
    rng = random.Random(1)
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    got = substrings.remove_repeats(frame(spark, texts, ids=ids), length, block_bytes=block, bucket_bytes=block).collect()
    want = brute_repeats(texts, ids, length)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want
    for r in got:
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] and sum(r["ends"]) - sum(r["starts"]) == r["n_removed"]


def test_long_texts_are_cut_into_overlapping_segments(spark, monkeypatch, texts):
    monkeypatch.setattr(substrings, "SEGMENT", 300)
    data, offsets = common_column(texts)
    seen = set()
    for part, starts, rows, shift in substrings.segments(data, offsets, 50):
        for k, row in enumerate(rows):
            for p in range(starts[k + 1] - starts[k] - 49):
                seen.add((int(row), int(shift[k]) + p))
                assert bytes(part[starts[k] + p : starts[k] + p + 50]) == bytes(data[offsets[row] + shift[k] + p : offsets[row] + shift[k] + p + 50])
    assert seen == {(r, p) for r, t in enumerate(texts) for p in range(len((t or "").encode()) - 49)}


def common_column(texts):
    import pyarrow as pa

    from siftmill.llm.kernels import text_column

    return text_column(pa.array([None if t is None else t.encode() for t in texts], pa.binary()))


def test_repeats_null_and_equal_keys(spark):
    long = "the same passage of text, long enough to be found again in full. "
    rows = frame(spark, [long, long, long, long], ids=[None, 7, 7, 9])
    got = sorted(((r["doc_id"] is None, r["doc_id"], r["n_removed"]) for r in substrings.remove_repeats(rows, 50).collect()), key=str)
    assert got == sorted([(True, None, 0), (False, 7, 0), (False, 7, 0), (False, 9, len(long))], key=str)
    assert substrings.remove_repeats(frame(spark, []), 50).count() == 0


def brute_near(texts, ids, width, percent):
    sets = {}
    for i, t in zip(ids, texts, strict=True):
        w = words(t)
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(ids)
    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_equal_brute_force(spark, texts, width):
    ids = list(range(len(texts)))
    random.Random(3).shuffle(ids)
    got = near_dedup.near_duplicates(frame(spark, texts, ids=ids), width).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == brute_near(texts, ids, width, 80)


def test_near_duplicates_of_a_large_group_and_a_chain(spark):
    rng = random.Random(8)
    base = [f"w{k}" for k in range(60)]
    chain, now = [], list(base)
    for k in range(25):
        now = list(now)
        now[rng.randrange(60)] = f"c{k}"
        chain.append(" ".join(now))
    texts = [*chain, *[" ".join(base) + f" tail{k}" for k in range(150)]]
    rng.shuffle(texts)
    got = near_dedup.near_duplicates(frame(spark, texts), 4).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == brute_near(texts, list(range(len(texts))), 4, 80)


def test_near_duplicates_edges(spark):
    rows = frame(spark, ["a b c d e f", "a b c d e f", "a b c d e f", None, "x"], ids=[None, 4, 4, 5, None])
    got = sorted((str(r["doc_id"]), r["component_id"], r["kept"], r["n_shingles"]) for r in near_dedup.near_duplicates(rows, 4).collect() if r["doc_id"] is not None)
    assert got == [("4", 4, True, 3), ("4", 4, True, 3), ("5", 5, True, 0)]
    assert near_dedup.near_duplicates(rows, 4).where("doc_id is null and component_id is null and kept").count() == 2
    assert near_dedup.near_duplicates(frame(spark, []), 4).count() == 0
    with pytest.raises(ValueError):
        near_dedup.near_duplicates(rows, 4, percent=50)


def test_circulant_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    items = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = items[:2000], items[500:2500]
    sig = near_dedup.circulant_signatures([a, b], 400)
    assert abs((sig[0] == sig[1]).mean() - 1500 / 2500) < 0.08


def test_jump_hash_moves_rows_only_into_the_new_shard():
    keys = np.concatenate([np.arange(-500, 5000), np.array([2**62, -(2**63)])])
    before, after = sharding.jump_hash(keys, 16), sharding.jump_hash(keys, 17)
    assert set(before.tolist()) == set(range(16)) and set(after[after != before].tolist()) == {16}
    assert abs((after != before).mean() - 1 / 17) < 0.02

    def plain(key, n):
        key, b, j = key % 2**64, -1, 0
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return b

    assert before.tolist() == [plain(int(k), 16) for k in keys]
    with pytest.raises(ValueError):
        sharding.jump_hash(keys, 0)


def test_shards_have_gapless_slots(spark, texts):
    rows = frame(spark, [*texts, "a", "a"], ids=[*range(len(texts)), None, 3])
    got = sharding.shard_documents(rows, 5, slot_rows=3).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 5) and r["law"] == "key"
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and len(got) == len(texts) + 2
    by = {r["doc_id"]: r for r in got if r["doc_id"] != 3}
    assert all(by[i]["size"] == len((t or "").encode()) + 1 and by[i]["text_crc32"] == zlib.crc32((t or "").encode()) for i, t in enumerate(texts) if i != 3)
    assert sharding.shard_documents(frame(spark, []), 5).count() == 0


def brute_targets(sizes, weights, budget, most):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    capped: set = set()
    while True:
        rest, left = [s for s in order if s not in capped], budget - sum(most * sizes[s] for s in capped)
        goal = {s: most * sizes[s] if s in capped else w[s] * left / sum(w[x] for x in rest) for s in order}
        over = {s for s in rest if goal[s] > most * sizes[s]}
        if not over:
            return goal
        capped |= over


def test_mix_meets_targets(spark, texts):
    many = texts * 6
    rng = random.Random(2)
    sources = [rng.choice(["b", "a", "é", None, "zz", "b", "b"]) for _ in many]
    got = mixing.mix(frame(spark, many, sources), mixing.word_count(F.col("text")), [3, 1, 2], (3, 2)).collect()
    size = {i: len(words(t)) for i, t in enumerate(many)}
    per = Counter()
    for i, s in enumerate(sources):
        per[s] += size[i]
    goal = brute_targets(per, [3, 1, 2], 1.5 * sum(per.values()), 2)
    taken = Counter()
    for r in got:
        s = sources[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == per[s] and math.isclose(r["target"], goal[s]) and r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert len(got) == len(many) and all(0 <= goal[s] - taken[s] <= max(size.values()) for s in per)
    again = mixing.mix(frame(spark, many, sources).repartition(2), mixing.word_count(F.col("text")), [3, 1, 2], (3, 2)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    smaller = {r["doc_id"] for r in mixing.mix(frame(spark, many, sources), mixing.word_count(F.col("text")), [1], (1, 4)).collect() if r["taken"]}
    larger = {r["doc_id"] for r in mixing.mix(frame(spark, many, sources), mixing.word_count(F.col("text")), [1], (1, 3)).collect() if r["taken"]}
    assert smaller <= larger


def test_mix_edges(spark):
    assert mixing.mix(frame(spark, []), mixing.word_count(F.col("text")), [3, 1, 2], (3, 2)).count() == 0
    got = mixing.mix(frame(spark, [None, "", "a b"], ["s", "s", "t"], ids=[1, 1, None]), mixing.word_count(F.col("text")), [3, 1, 2], (3, 2)).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in got) == [("1", 0, 0), ("1", 0, 0), ("None", 2, 2)]


def test_media_round_trip(spark, texts):
    long = "é0123456789" * 9000
    rows = frame(spark, [*texts, long])
    for r in media.media_column(rows).collect():
        body = ([*texts, long][r["doc_id"]] or "").encode()
        payload = body + bytes(-len(body) % 64 or (64 if not body else 0))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(body), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = media.write_media(payload)
        assert r["media_bytes"] == len(stored) and r["media_sha256"] == hashlib.sha256(stored).hexdigest()
    assert media.media_column(frame(spark, [])).count() == 0


def test_media_probe_finds_key_frames_and_survives_damage(spark):
    payload = bytes(range(256)) * 400
    stored = media.write_media(payload)
    found = media.probe(stored)
    assert (found["codec"], found["brand"], found["duration"], found["timescale"], found["samples"]) == ("raw ", "isom", len(payload), media.TIMESCALE, 25)
    for k in found["keyframes"]:
        at = (k["sample"] - 1) * media.SAMPLE_BYTES
        assert stored[k["start"] : k["end"]] == payload[at : at + media.SAMPLE_BYTES]
    rows = [(stored,), (None,), (b"",), (stored[:200],), (b"\0\0\0\1free" + bytes(8),), (stored[:-9],)]
    out = media.probe_media(spark.createDataFrame(rows, "content binary"), to="m").select("m.*").collect()
    assert out[0]["error"] is None and out[0]["bytes"] == len(payload) and all(r["error"] for r in out[1:])


def test_warc_records_are_linked_and_parse(spark):
    page = '<html lang="en"><head><title>A &amp; B</title><script>x<y</script></head><body><p>One<br>two <b>three</b></p><!-- gone --><a href="/u?a=1&amp;b=2">go</a></body></html>'
    rows = spark.createDataFrame([(1, "http://e.org/x", page, "k"), (2, None, None, "k"), (1, "http://e.org/x", page, "k")], "page_id long, url string, html string, record string")
    got = warc.build_warc(rows).collect()
    assert len(got) == 9
    for r in got:
        headers, block = warc.parse(bytes(r["record"]))
        assert headers["warc-block-digest"] == warc.digest(block) == r["block_digest"] and len(block) == r["content_length"]
    one = {r["record_type"]: r for r in got if r["page_id"] == 1}
    assert one["metadata"]["refers_to"] == one["conversion"]["refers_to"] == one["response"]["record_id"] and one["response"]["refers_to"] is None
    assert warc.parse(bytes(one["conversion"]["record"]))[1].decode() == "A & B\nOne\ntwo three\ngo"
    fields = warc.parse(bytes(one["metadata"]["record"]))[1].decode()
    assert "title: A & B\r\n" in fields and "outlink: /u?a=1&b=2\r\n" in fields and f"source-payload-digest: {warc.digest(page.encode())}" in fields
    assert one["metadata"]["warc_date"] == one["response"]["warc_date"] and one["metadata"]["target_uri"] == "http://e.org/x"
    assert warc.build_warc(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        warc.parse(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n")


def test_spaced_seeds_meet_every_window_with_three_substitutions():
    from itertools import combinations

    span, most = decontaminate.SPAN, decontaminate.SPAN - decontaminate.MIN_MATCH
    for changed in combinations(range(span), most):
        assert any(all(o + k not in changed for k, bit in enumerate(m) if bit == "1") for m in decontaminate.MASKS for o in range(span - len(m) + 1))


def test_decontamination_tolerates_substitutions(spark):
    rng = random.Random(4)
    pool = [f"t{k}" for k in range(3000)]
    items = [[rng.choice(pool) for _ in range(n)] for n in (16, 20, 40, 9, 5, 3)]
    docs, want = [], set()
    for k, item in enumerate(items):
        noise = [rng.choice(pool) for _ in range(50)]
        docs.append(" ".join(noise[:20] + item + noise[20:]))
        want.add((len(docs) - 1, k))
    changed = list(items[2])
    for p in (3, 8, 14, 20, 26, 33):
        changed[p] = "other"
    docs.append("Before " + " ".join(changed).upper() + " after")
    want.add((len(docs) - 1, 2))
    docs += [None, "", " ".join(rng.choice(pool) for _ in range(400)), " ".join(items[2][:12])]
    bench = spark.createDataFrame([(k, " ".join(i), "x") for k, i in enumerate(items)] + [(90, None, "x"), (91, "", "x")], "item_id long, text string, doc_id string")
    for limit in (decontaminate.BLOCK_SEEDS, 30):
        got = decontaminate.contaminated(frame(spark, docs), bench, block_seeds=limit).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    assert {r["n_matched"] for r in got if r["doc_id"] == 6} == {34}
    assert decontaminate.contaminated(frame(spark, []), bench).count() == 0
    assert decontaminate.contaminated(frame(spark, docs), bench.limit(0)).count() == 0


def test_license_rules(spark):
    S = licenses.SENTENCES
    say = lambda *ids: " ".join(S[i][0].capitalize() + "." for i in ids)
    texts = [
        "Some words.\nReleased under the MIT License.\nMore words",
        say("bsd_grant", "bsd_source", "bsd_binary"),
        say("bsd_grant", "bsd_source", "bsd_binary") + " Other words here. " + say("bsd_endorse"),
        say("bsd_source", "bsd_grant"),
        "Licensed under CC BY-NC 4.0. All rights reserved.",
        "Licensed  under the\nApache License, Version 2.0.",
        "unlicensed text without rules. This license is unknown.",
        None,
        "",
    ]
    got = {r["doc_id"]: (r["licenses"], r["n_sentences"]) for r in licenses.scan_licenses(frame(spark, texts)).collect()}
    assert got == {0: ("MIT-notice", 1), 1: ("BSD-2-Clause", 3), 2: ("BSD-3-Clause", 4), 3: ("", 2), 4: ("CC-BY-NC-4.0,All-rights-reserved", 2), 5: ("Apache-2.0-notice", 1)}
    assert licenses.scan_licenses(frame(spark, [])).count() == 0


def test_resampling_prefers_the_target(spark):
    rng = random.Random(6)
    pool = [f"word{k}" for k in range(300)]
    texts, rows = [], []
    for i in range(400):
        bad = i % 4 == 0
        w = [rng.choice(pool) for _ in range(60)]
        texts.append(" ".join(x.upper() + "!!" for x in w) if bad else " ".join(w))
        if i % 2 == 0:
            rows.append((i, 0 if bad else 1, 0))
    rows += [(None, 1, 0), (0, 0, 1), (99999, 0, 0)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    target = (F.col("quality") == 1) & (F.col("toxic") == 0)
    kept = {r["doc_id"] for r in quality.resample(frame(spark, texts), labels, target, k=300).collect()}
    assert len(kept) == 300 and len(kept & {i for i in range(400) if i % 4}) >= 280
    some = {r["doc_id"] for r in quality.resample(frame(spark, texts), labels, target, k=100).collect()}
    assert len(some) == 100 and some < kept
    assert quality.resample(frame(spark, []), labels, target).count() == 0
    assert quality.resample(frame(spark, texts), labels.limit(0), target).count() == 0
    assert quality.resample(frame(spark, [None, "", "a"], ids=[1, None, 1]), labels, target, k=3).count() == 3


def test_kth_largest(spark):
    values = [5, 5, 9, 1, 0, 9, 7, 2**47, 2**47 - 1]
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    for k in range(1, len(values) + 1):
        assert quality.kth_largest(rows, "v", k, 48, 5) == sorted(values, reverse=True)[k - 1]
    assert quality.kth_largest(rows, "v", 0) is None and quality.kth_largest(rows, "v", 99, 48) is None


def test_symbols_and_tree_are_a_distribution(texts):
    data, offsets = common_column(texts)
    text, begin = lm.symbols(data, offsets - offsets[0])
    for k, t in enumerate(texts):
        assert bytes(text[begin[k] : begin[k + 1]]) == "".join(w + " " for w in words(t)).encode() + b"\n"
    keys, n = np.unique(lm.grams(text, begin, 3), return_counts=True)
    rows = tree_rows(keys, n, 3, 3.0)
    found = lm.levels(keys, n, range(4), divergence=3.0)

    def p_of(these):
        p = np.zeros(len(these))
        for level in found:
            p = level.refine(p, these)
        return p

    contexts = np.unique(keys >> np.uint64(8))[::50]
    every = (contexts[:, None] << np.uint64(8)) | np.arange(256, dtype=np.uint64)[None, :]
    assert np.allclose(p_of(every.reshape(-1)).reshape(len(contexts), 256).sum(axis=1), 1, atol=1e-6)
    table = defaultdict(dict)
    for d, c, s, m in rows:
        table[d, c][s] = m
    logs = np.log10(p_of(lm.grams(text, begin, 3)))
    got = [logs[begin[k] : begin[k + 1]].sum() for k in range(len(texts))]
    assert np.allclose(got, [brute_tree(table, bytes(text[begin[k] : begin[k + 1]]), 3) for k in range(len(texts))], rtol=1e-4)


def tree_rows(keys, n, depth, divergence):
    rows, previous = [], None
    for d in range(depth + 1):
        level = defaultdict(Counter)
        for g, m in zip(keys.tolist(), n.tolist(), strict=True):
            level[(g >> 8) & ((1 << 8 * d) - 1)][g & 255] += m
        for c, t in level.items():
            if d:
                up = previous[c & ((1 << 8 * (d - 1)) - 1)]
                gain = sum(m * math.log((m / sum(t.values())) / (up[s] / sum(up.values()))) for s, m in t.items())
            if not d or gain >= divergence:
                rows += [(d, c, s, m) for s, m in t.items()]
        previous = level
    return rows


def brute_tree(table, text, depth):

    def p(d, c, s):
        while (d, c) not in table:
            d -= 1
            c &= (1 << 8 * d) - 1
        own = table[d, c]
        if not d:
            return (own.get(s, 0) + lm.FLOOR) / (sum(own.values()) + lm.FLOOR * 256)
        return (own.get(s, 0) + lm.BACKOFF * p(d - 1, c & ((1 << 8 * (d - 1)) - 1), s)) / (sum(own.values()) + lm.BACKOFF)

    total, history = 0.0, (1 << 8 * depth) - 1
    for s in text:
        total += math.log10(p(depth, history & ((1 << 8 * depth) - 1), s))
        history = (history << 8) | s
    return total


def test_lm_base_score_equals_brute_force(spark, texts):
    many = texts * 3
    got = lm.score_documents(frame(spark, [*many, "z z"], ids=[*range(len(many)), None]), block_bytes=2000, bucket_bytes=2000).collect()
    train = [i for i in range(len(many)) if zlib.crc32(str(i).encode()) % 10]
    counts = Counter()
    for i in train:
        counts.update([*words(many[i]), None])
    N, V = sum(counts.values()), len(counts)
    assert len(got) == len(many) + 1
    for r in got:
        tokens = [*words("z z" if r["doc_id"] is None else many[r["doc_id"]]), None]
        want = sum(math.log10((counts[t] + 0.1) / (N + 0.1 * (V + 1))) for t in tokens)
        assert r["train_tokens"] == N and r["n_tokens"] == len(tokens) and r["n_known"] == sum(counts[t] > 0 for t in tokens) and math.isclose(r["base_score"], want, rel_tol=1e-9)
        assert r["score"] < 0 and r["held_out"] == (zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 10 == 0)
    assert lm.score_documents(frame(spark, [])).count() == 0


def test_lm_tree_rows_follow_the_definition(spark, texts):
    data, offsets = common_column(texts)
    text, begin = lm.symbols(data, offsets - offsets[0])
    keys, n = np.unique(lm.grams(text, begin, 3), return_counts=True)
    counted = lm.count_grams(spark.createDataFrame([(i, bytearray((t or "").encode())) for i, t in enumerate(texts)], "doc_id long, text binary"), 3, lambda x: True)
    assert {r["gram"]: r["n"] for r in counted.collect()} == dict(zip(keys.tolist(), n.tolist(), strict=True))
    kept = {(d, c) for d, level in enumerate(lm.levels(keys, n, range(4), divergence=3.0)) for c in level.context[level.kept].tolist()}
    assert kept == {(d, c) for d, c, _, _ in tree_rows(keys, n, 3, 3.0)}


def test_common(spark):
    assert common.small(spark.range(5), 10).count() == 5 and common.small(spark.range(50), 10).count() == 50
