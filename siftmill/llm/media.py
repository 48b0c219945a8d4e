"""Media columns: ISO base media containers, written from payloads and probed without decoding them."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

UNIT = 64
#: Payload bytes that one media sample of the writer holds, samples between two key frames, and ticks a second.
SAMPLE_BYTES, KEY_EVERY, TIMESCALE = 4096, 16, 8000
#: Boxes that hold boxes, and how deep they may.
NESTED = (b"moov", b"trak", b"mdia", b"minf", b"dinf", b"stbl", b"edts", b"mvex", b"moof", b"traf")
MAX_DEPTH = 16
#: The flag of samples in fragments that are no key frames.
NOT_SYNC = 0x10000

_STREAM = "codec:string,timescale:long,duration:long,seconds:double,samples:long,bytes:long,keyframes:array<struct<sample:long,start:long,end:long>>"
FEATURES = f"struct<error:string,brand:string,tracks:int,{_STREAM},streams:array<struct<track_id:long,handler:string,{_STREAM}>>>"


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def _table(kind: bytes, rows: list[tuple[int, ...]]) -> bytes:
    return _full(kind, struct.pack(">I", len(rows)), *(struct.pack(f">{len(r)}I", *r) for r in rows))


def write_media(payload: bytes) -> bytes:
    """One track of unsigned 8-bit mono samples ('raw ') whose bytes are the payload, in chunks of SAMPLE_BYTES."""
    sizes = [len(payload[i : i + SAMPLE_BYTES]) for i in range(0, len(payload), SAMPLE_BYTES)]
    ticks = len(payload)
    runs: list[tuple[int, int]] = []
    for n in sizes:
        runs = [*runs[:-1], (runs[-1][0] + 1, n)] if runs and runs[-1][1] == n else [*runs, (1, n)]
    unity = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = _box(b"raw ", struct.pack(">6xHQHHHHI", 1, 0, 1, 8, 0, 0, TIMESCALE << 16))

    def moov(start: int) -> bytes:
        offsets, at = [], start
        for n in sizes:
            offsets.append(at)
            at += n
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _table(b"stts", runs),
            _table(b"stss", [(k + 1,) for k in range(0, len(sizes), KEY_EVERY)]),
            _table(b"stsc", [(1, 1, 1)]),
            _full(b"stsz", struct.pack(">II", 0, len(sizes)), *(struct.pack(">I", n) for n in sizes)),
            _table(b"stco", [(x,) for x in offsets]) if at < 1 << 32 else _full(b"co64", struct.pack(">I", len(offsets)), *(struct.pack(">Q", x) for x in offsets)),
        )
        mdia = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, ticks, 0x55C4, 0)),
            _full(b"hdlr", bytes(4), b"soun", bytes(12), b"payload\0"),
            _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl),
        )
        track = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, ticks), bytes(8), struct.pack(">hhhh", 0, 0, 0x100, 0), unity, bytes(8), flags=7)
        return _box(b"moov", _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, TIMESCALE, ticks, 0x10000, 0x100), bytes(10), unity, bytes(24), struct.pack(">I", 2)), _box(b"trak", track, mdia))

    head = _box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isom")
    start = len(head) + len(moov(0)) + 8
    return head + moov(start) + struct.pack(">I4s", len(payload) + 8, b"mdat") + payload


def walk(data: memoryview, start: int, end: int, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int, int]]:
    """(path, first byte, first byte of the body, end) of every box, entering those that nest."""
    if len(path) > MAX_DEPTH:
        raise ValueError("boxes nest too deep")
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            (size,), head = struct.unpack_from(">Q", data, start + 8), 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} at byte {start} ends outside its parent")
        yield (*path, kind), start, start + head, start + size
        if kind in NESTED:
            yield from walk(data, start + head, start + size, (*path, kind))
        start += size


def _rows(data: memoryview, start: int, end: int, fields: str, skip: int = 4) -> list[tuple[int, ...]]:
    """A counted table behind `skip` bytes of the body."""
    (n,) = struct.unpack_from(">I", data, start + skip)
    width, first = struct.calcsize(f">{fields}"), start + skip + 4
    if first + n * width > end:
        raise ValueError("a sample table is cut off")
    return list(struct.iter_unpack(f">{fields}", data[first : first + n * width]))


def _table_places(data: memoryview, at: dict[bytes, tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte range of each sample of the track's own tables."""
    start, end = at[b"stsz"]
    same, n = struct.unpack_from(">II", data, start + 4)
    if n > len(data) or (not same and start + 12 + 4 * n > end):
        raise ValueError("a sample table is cut off")
    sizes = [same] * n if same else struct.unpack_from(f">{n}I", data, start + 12)
    chunks = [x[0] for x in (_rows(data, *at[b"co64"], "Q") if b"co64" in at else _rows(data, *at[b"stco"], "I"))]
    dealt = _rows(data, *at[b"stsc"], "III")
    places: list[tuple[int, int]] = []
    for k, (first, each, _) in enumerate(dealt):
        for chunk in range(first, dealt[k + 1][0] if k + 1 < len(dealt) else len(chunks) + 1):
            if not 1 <= chunk <= len(chunks):
                raise ValueError("a chunk has no offset")
            byte = chunks[chunk - 1]
            for size in sizes[len(places) : len(places) + each]:
                places.append((byte, byte + size))
                byte += size
    if len(places) != n:
        raise ValueError("the chunks hold fewer samples than the size table")
    return places


def _track(data: memoryview, at: dict[bytes, tuple[int, int]]) -> dict:
    """What a track's own boxes say; its movie fragments add to it."""
    missing = [k.decode() for k in (b"tkhd", b"mdhd", b"stsd", b"stts", b"stsc", b"stsz") if k not in at]
    if missing:
        raise ValueError(f"no {', '.join(missing)} in a track")
    out: dict = {}
    start, _ = at[b"tkhd"]
    (out["track_id"],) = struct.unpack_from(">I", data, start + (20 if data[start] else 12))
    start, _ = at[b"mdhd"]
    out["timescale"], out["duration"] = struct.unpack_from(">IQ", data, start + 20) if data[start] else struct.unpack_from(">II", data, start + 12)
    if b"hdlr" in at:
        out["handler"] = bytes(data[at[b"hdlr"][0] + 8 : at[b"hdlr"][0] + 12]).decode("latin-1")
    out["codec"] = bytes(data[at[b"stsd"][0] + 12 : at[b"stsd"][0] + 16]).decode("latin-1")
    out["places"] = _table_places(data, at)
    out["ticks"] = sum(a * b for a, b in _rows(data, *at[b"stts"], "II"))
    out["keys"] = [x[0] for x in _rows(data, *at[b"stss"], "I")] if b"stss" in at else list(range(1, len(out["places"]) + 1))
    return out


def _fragment(data: memoryview, start: int, defaults: dict[int, tuple[int, ...]]) -> dict:
    """Header of a track fragment: track, whether and where its data have a base, and duration, size and flags of its samples."""
    flags, track = struct.unpack_from(">II", data, start)
    at, found = start + 8, {}
    for bit, name, width in ((1, "base", 8), (2, "entry", 4), (8, "duration", 4), (16, "size", 4), (32, "flags", 4)):
        if flags & bit:
            found[name] = int.from_bytes(data[at : at + width], "big")
            at += width
    _, duration, size, kind = defaults.get(track, (0, 0, 0, 0))
    return {"track": track, "duration": duration, "size": size, "flags": kind, "at_moof": bool(flags & 0x20000), **found}


def _run(data: memoryview, start: int, end: int, part: dict, track: dict) -> None:
    """Add the samples of a track run; `part["next"]` is where the data of a run without an offset begin."""
    flags, n = struct.unpack_from(">II", data, start)
    flags, at, first = flags & 0xFFFFFF, start + 8, None
    byte = part["next"]
    if flags & 1:
        byte, at = part["base"] + struct.unpack_from(">i", data, at)[0], at + 4
    if flags & 4:
        (first,), at = struct.unpack_from(">I", data, at), at + 4
    given = [name for bit, name in ((0x100, "duration"), (0x200, "size"), (0x400, "flags"), (0x800, "shift")) if flags & bit]
    if n > len(data) or at + 4 * len(given) * n > end:
        raise ValueError("a track run is cut off")
    for k in range(n):
        sample = dict(zip(given, struct.unpack_from(f">{len(given)}I", data, at + 4 * len(given) * k), strict=True))
        size = sample.get("size", part["size"])
        kind = first if k == 0 and first is not None and "flags" not in sample else sample.get("flags", part["flags"])
        track["places"].append((byte, byte + size))
        track["ticks"] += sample.get("duration", part["duration"])
        if not kind & NOT_SYNC:
            track["keys"].append(len(track["places"]))
        byte += size
    part["next"] = byte


def probe(content: bytes) -> dict:
    """Brand, number of tracks, and of each track codec, duration, sample places and key frame byte ranges.

    Samples are those of the sample tables, then those of the movie fragments in file order. The first track's values
    also stand on top. Payloads are not read.
    """
    data = memoryview(content)
    out: dict = {"tracks": 0}
    boxes: list[dict[bytes, tuple[int, int]]] = []
    defaults: dict[int, tuple[int, ...]] = {}
    tracks: dict[int, dict] = {}
    part: dict = {}
    moof, latest = 0, None
    for path, box, start, end in walk(data, 0, len(data)):
        kind = path[-1]
        if kind == b"ftyp":
            out["brand"] = bytes(data[start : start + 4]).decode("latin-1")
        elif kind == b"trak":
            boxes.append({})
        elif b"trak" in path and boxes:
            boxes[-1].setdefault(kind, (start, end))
        elif kind == b"trex":
            track, *rest = struct.unpack_from(">IIIII", data, start + 4)
            defaults[track] = tuple(rest)
        elif kind == b"moof":
            moof, latest = box, None
            if not tracks:
                tracks = {t["track_id"]: t for t in (_track(data, at) for at in boxes)}
        elif kind == b"tfhd":
            part = _fragment(data, start, defaults)
            # Without a base of its own, a fragment's data follow those of the one before in its moof.
            part.setdefault("base", moof if part["at_moof"] or latest is None else latest)
            part["next"] = part["base"]
        elif kind == b"trun":
            if part.get("track") not in tracks:
                raise ValueError("a fragment belongs to no track")
            _run(data, start, end, part, tracks[part["track"]])
            latest = part["next"]
    found = list(tracks.values()) or [_track(data, at) for at in boxes]
    if not found:
        raise ValueError("no track")
    for t in found:
        if any(a < 0 or b > len(data) for a, b in t["places"]):
            raise ValueError("a sample lies outside the file")
        t["duration"] = t.pop("ticks") or t["duration"]
        t["seconds"] = t["duration"] / t["timescale"] if t["timescale"] else None
        t["samples"], t["bytes"] = len(t["places"]), sum(b - a for a, b in t["places"])
        t["keyframes"] = [{"sample": k, "start": t["places"][k - 1][0], "end": t["places"][k - 1][1]} for k in t.pop("keys")]
    return out | found[0] | {"tracks": len(found), "streams": found}


def probe_media(df: DataFrame, content: str = "content", to: str = "media") -> DataFrame:
    """Add a struct with the container's codec, duration, sample count and key frame byte ranges: those of the first
    track, and in `streams` those of every track.

    Null content and bytes that are no readable container give a struct whose `error` says why and whose other fields
    are null; no row is lost and none fails the job.
    """
    kind = to_arrow_type(DataType.fromDDL(FEATURES))

    def one(data: bytes | None) -> dict:
        if data is None:
            return {"error": "null"}
        try:
            return probe(data)
        except (ValueError, IndexError, KeyError, struct.error) as e:
            return {"error": str(e) or type(e).__name__}

    @F.arrow_udf(FEATURES)
    def probed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([one(x.as_py()) for x in batch], kind)

    return df.withColumn(to, probed(F.col(content)))


STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _stored(text: bytes) -> tuple:
    payload = text + bytes(-len(text) % UNIT or UNIT * (not text))
    media = write_media(payload)
    found = probe(media)
    back = b"".join(media[a:b] for a, b in found["places"])
    keys = ",".join(f"{k['start']}-{k['end']}" for k in found["keyframes"])
    feature = f"{found['brand']};{found['codec']};{found['duration']}/{found['timescale']};samples={found['samples']};keys={keys}"
    return len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature


def media_column(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text (null: empty) as UTF-8, zero-padded to a positive multiple of 64, stored as 8-bit samples of an ISO
    container, read back through its sample tables, with digests of both and the container's features.

    Features name brand, codec, duration, sample count and the byte range of every key frame. Equal texts give equal
    values; every input row gives one row, also with a null or repeated key; an empty table gives an empty one; other
    columns of the input are left out. A text is held whole, with its stored form, in one task.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_stored(x.as_py() or b"") for x in batch.column(1).cast(pa.large_binary())]
            columns = list(zip(*rows, strict=True)) or [[] for _ in range(7)]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[x.split()[0] for x in STORED.split(", ")])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(each, STORED)
