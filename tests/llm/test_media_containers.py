"""Containers of several tracks and of fragments, built here byte by byte; the stored form read without the operator's reader."""

import hashlib
import struct

from siftmill.llm import media


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I", len(body) + 8) + kind + body


def u32(*values):
    return struct.pack(f">{len(values)}I", *values)


def track(number, codec, handler, scale, ticks=(), sizes=(), offsets=(), per_chunk=1, sync=None):
    stbl = [
        box(b"stsd", u32(0, 1), box(codec, bytes(8))),
        box(b"stts", u32(0, len(ticks)), *(u32(*t) for t in ticks)),
        box(b"stsc", u32(0, 1, 1, per_chunk, 1) if sizes else u32(0, 0)),
        box(b"stsz", u32(0, 0, len(sizes), *sizes)),
        box(b"stco", u32(0, len(offsets), *offsets)),
    ]
    if sync is not None:
        stbl.append(box(b"stss", u32(0, len(sync), *sync)))
    return box(b"trak", box(b"tkhd", u32(7, 0, 0, number, 0)), box(b"mdia", box(b"mdhd", u32(0, 0, 0, scale, 0, 0)), box(b"hdlr", u32(0, 0), handler), box(b"minf", box(b"stbl", *stbl))))


def test_every_track_has_its_own_samples():
    head = box(b"ftyp", b"mp42", u32(0))
    made = lambda at: box(b"moov", track(1, b"avc1", b"vide", 90, [(3, 30)], [5, 6, 7], [at, at + 15], 2, [1, 3]), track(9, b"mp4a", b"soun", 48, [(2, 24)], [2, 2], [at + 11], 2))
    start = len(head) + len(made(0)) + 8
    data = head + made(start) + box(b"mdat", b"AAAAABBBBBB" + b"aabb" + b"CCCCCCC")
    found = media.probe(data)
    assert (found["brand"], found["tracks"], found["codec"], found["seconds"]) == ("mp42", 2, "avc1", 1.0)
    video, sound = found["streams"]
    assert [data[k["start"] : k["end"]] for k in video["keyframes"]] == [b"AAAAA", b"CCCCCCC"] and video["samples"] == 3 and video["bytes"] == 18
    assert (sound["track_id"], sound["handler"], sound["codec"], sound["duration"], sound["bytes"]) == (9, "soun", "mp4a", 48, 4)
    assert [data[k["start"] : k["end"]] for k in sound["keyframes"]] == [b"aa", b"bb"]


def fragmented():
    """Two fragments: the first holds both tracks one after the other, the second a run without an offset behind another."""
    moov = box(b"moov", track(1, b"hvc1", b"vide", 10), track(2, b"Opus", b"soun", 100), box(b"mvex", box(b"trex", u32(0, 1, 1, 10, 4, 0x10000)), box(b"trex", u32(0, 2, 1, 50, 3, 0))))
    out = box(b"ftyp", b"iso6", u32(0)) + moov

    def moof(offset):
        video = box(b"traf", box(b"tfhd", u32(0x20000, 1)), box(b"trun", u32(0x1 | 0x4 | 0x200, 2, offset, 0, 6, 5)))
        return box(b"moof", video, box(b"traf", box(b"tfhd", u32(0, 2)), box(b"trun", u32(0, 2))))

    out += moof(len(moof(0)) + 8) + box(b"mdat", b"VIDEO1" + b"video" + b"so1" + b"so2")

    def later(offset):
        runs = box(b"trun", u32(0x1 | 0x100 | 0x400, 1, offset, 20, 0)), box(b"trun", u32(0x800, 1, 7))
        return box(b"moof", box(b"traf", box(b"tfhd", u32(0x20000 | 0x8 | 0x10, 1, 30, 2)), *runs))

    return out + later(len(later(0)) + 8) + box(b"mdat", b"KKnn")


def test_fragments_add_their_samples():
    data = fragmented()
    video, sound = media.probe(data)["streams"]
    assert [data[a:b] for a, b in video["places"]] == [b"VIDEO1", b"video", b"KK", b"nn"]
    assert [k["sample"] for k in video["keyframes"]] == [1, 3] and video["duration"] == 10 + 10 + 20 + 30 and video["codec"] == "hvc1"
    assert [data[a:b] for a, b in sound["places"]] == [b"so1", b"so2"] and sound["duration"] == 100 and len(sound["keyframes"]) == 2


def test_damaged_containers_give_an_error_each(spark):
    data = fragmented()
    deep = b""
    for _ in range(3000):
        deep = box(b"moov", deep)
    rows = [(0, data), (1, deep), (2, None), (3, b""), (4, data.replace(u32(0, 2) + b"\0", u32(0, 2**31) + b"\0")), (5, box(b"moof", box(b"traf", box(b"tfhd", u32(0, 4)), box(b"trun", u32(0, 1)))))]
    rows += [(10 + n, data[:n]) for n in range(1, len(data) - 30, 7)]
    got = {r["id"]: r["m"] for r in media.probe_media(spark.createDataFrame(rows, "id long, content binary"), to="m").collect()}
    assert len(got) == len(rows) and got[0]["error"] is None and [s["codec"] for s in got[0]["streams"]] == ["hvc1", "Opus"]
    assert all(got[k]["error"] for k in (1, 2, 3, 5))


def test_stored_form_and_feature_follow_from_the_payload(spark):
    texts = ["", "x", "é" * 40, "y" * 4096, "z0123456" * 20_000, None]
    for r in media.media_column(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        body = (texts[r["doc_id"]] or "").encode()
        payload = body.ljust(max(64, -(-len(body) // 64) * 64), b"\0")
        stored = media.write_media(payload)
        first = stored.index(b"mdat") + 4
        assert stored[first:] == payload and r["media_sha256"] == hashlib.sha256(stored).hexdigest() and r["media_bytes"] == first + len(payload)
        keys = ",".join(f"{first + k}-{first + min(k + 4096, len(payload))}" for k in range(0, len(payload), 16 * 4096))
        assert r["feature"] == f"isom;raw ;{len(payload)}/8000;samples={-(-len(payload) // 4096)};keys={keys}"
