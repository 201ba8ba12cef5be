"""MPEG audio columns (operator 1): resynchronise frames, parse tags and variable-bitrate tables, verify checksums, index.

`parse` reads any MPEG-1/2/2.5 audio bytes: ID3v2 tags at the front and an ID3v1 tag at the end are set aside, frame headers are
searched for byte by byte wherever no valid one follows (a header counts only if the next one, or the end, stands where it says),
a Xing/Info or VBRI frame is read as a table and not as sound, and the CRC-16 of protected frames is verified in all three layers.
Durations are exact fractions, in samples and rate; seek offsets are the byte offset of every frame.

`store` puts arbitrary bytes into such a stream without loss: silent, protected mono Layer III frames at 48 kHz whose
main-data room, which silence leaves free, carries the bytes. The bit rate of the last frame is the smallest that holds the rest.
Where the bytes read like an ID3v1 tag at the end, an empty real one follows them.
"""

from __future__ import annotations

import hashlib
import struct
import sys
import zlib
from bisect import bisect_left

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by (version 1?, layer), Hz by version bits, samples by (version 1?, layer).
KBITS = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SAMPLES = {(True, 1): 384, (True, 2): 1152, (True, 3): 1152, (False, 1): 384, (False, 2): 1152, (False, 3): 576}


# Fixed values of the same standards: bits of a Layer II bit allocation by subband, for the tables B.2a to B.2d and that of low rates.
ALLOCATION = {
    "a": (4,) * 11 + (3,) * 12 + (2,) * 4,
    "b": (4,) * 11 + (3,) * 12 + (2,) * 7,
    "c": (4,) * 2 + (3,) * 6,
    "d": (4,) * 2 + (3,) * 10,
    "low": (4,) * 4 + (3,) * 7 + (2,) * 19,
}
_headers: dict[bytes, dict | None] = {}
_sums: dict[tuple[bytes, int], int] = {}


def crc16(data: bytes, bits: int | None = None) -> int:
    """CRC-16 with polynomial 0x8005 from 0xFFFF, as MPEG audio uses it, over the first `bits` bits (all)."""
    bits = 8 * len(data) if bits is None else bits
    key = (data[: (bits + 7) // 8], bits)
    if key not in _sums:
        crc = 0xFFFF
        for k in range(bits):
            crc ^= (data[k >> 3] >> (7 - (k & 7)) & 1) << 15
            crc = (crc << 1 ^ 0x8005) & 0xFFFF if crc & 0x8000 else crc << 1
        if len(_sums) >= 4096:
            _sums.clear()
        _sums[key] = crc
    return _sums[key]


def header(four: bytes) -> dict | None:
    """The fields of a frame header, or None if the bytes can't be one (free-format frames are not followed)."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    if four not in _headers:
        if len(_headers) >= 4096:
            _headers.clear()
        _headers[four] = _header(four)
    return _headers[four]


def _header(four: bytes) -> dict | None:
    version, layer, rate = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3), four[2] >> 2 & 3
    bits, one = four[2] >> 4, version == 3
    if version == 1 or layer == 4 or rate == 3 or bits in (0, 15):
        return None
    hertz, kbits, padding = HERTZ[version][rate], KBITS[one, layer][bits], four[2] >> 1 & 1
    samples, mode = SAMPLES[one, layer], four[3] >> 6
    length = (12000 * kbits // hertz + padding) * 4 if layer == 1 else samples // 8 * 1000 * kbits // hertz + padding
    return {"version": version, "layer": layer, "hertz": hertz, "kbits": kbits, "samples": samples, "mono": mode == 3, "length": length,
            "bound": 4 * ((four[3] >> 4 & 3) + 1) if mode == 1 else 32, "crc": not four[1] & 1, "side": (17 if mode == 3 else 32) if one else (9 if mode == 3 else 17)}


def _allocation(head: dict) -> tuple[int, ...]:
    """Bits of each subband's allocation in a Layer I or II frame."""
    if head["layer"] == 1:
        return (4,) * 32
    if head["version"] != 3:
        return ALLOCATION["low"]
    each = head["kbits"] if head["mono"] else head["kbits"] // 2
    if each < 56:
        return ALLOCATION["d" if head["hertz"] == 32000 else "c"]
    return ALLOCATION["a" if each <= 80 or head["hertz"] == 48000 else "b"]


def _protected_bits(body: bytes, head: dict) -> int:
    """How many bits after the checksum it covers: side information, or bit allocation and (Layer II) scale factor selection."""
    if head["layer"] == 3:
        return 8 * head["side"]
    bits = int.from_bytes(body[:48])
    room, at, selected = 8 * len(body[:48]), 0, 0
    for band, n in enumerate(_allocation(head)):
        for _ in range(1 if head["mono"] or band >= head["bound"] else 2):
            if at + n <= room and bits >> (room - at - n) & ((1 << n) - 1):
                selected += 1 if head["mono"] or band < head["bound"] else 2
            at += n
    return at + (2 * selected if head["layer"] == 2 else 0)


def _same_stream(a: dict, b: dict) -> bool:
    return (a["version"], a["layer"], a["hertz"]) == (b["version"], b["layer"], b["hertz"])


def parse(data: bytes) -> dict:
    """Tags, table, frames (offset, header), their checksums, skipped bytes. Damaged or foreign bytes are skipped, never fatal."""
    out = {"tags": {}, "table": None, "frames": [], "crc_good": 0, "crc_bad": 0, "skipped": 0, "delay": 0, "data_from": 0}
    at, end = 0, len(data)
    while data[at: at + 3] == b"ID3" and at + 10 <= end:
        size = sum((b & 0x7F) << 7 * (3 - k) for k, b in enumerate(data[at + 6: at + 10]))
        body, p = data[at + 10: at + 10 + size], 0
        while p + 10 <= len(body) and body[p]:
            n = int.from_bytes(body[p + 4: p + 8])
            if data[at + 3] >= 4:
                n = sum((b & 0x7F) << 7 * (3 - k) for k, b in enumerate(body[p + 4: p + 8]))
            out["tags"][body[p: p + 4].decode("latin-1")] = _tag_text(body[p + 10: p + 10 + n])
            p += 10 + n
        at += 10 + size
    out["data_from"] = at
    if end - at >= 128 and data[end - 128: end - 125] == b"TAG":
        out["tags"]["ID3v1"] = data[end - 125: end - 95].rstrip(b"\0 ").decode("latin-1")
        end -= 128
    last, expected = None, -1
    while at + 4 <= end:
        head = header(data[at: at + 4])
        if head and at + head["length"] <= end and (last is None or _same_stream(last, head)):
            after = at + head["length"]
            following = header(data[after: after + 4])
            if at == expected or after == end or following and _same_stream(head, following):
                _take(out, data, at, head)
                last, at, expected = head, after, after
                continue
        found = data.find(b"\xff", at + 1, end)
        found = end if found < 0 else found
        out["skipped"] += found - at
        at = found
    out["skipped"] += max(0, end - at)
    return out


def _tag_text(body: bytes) -> str:
    """The text of a tag frame by its encoding byte (0: Latin-1, 1: UTF-16 with a mark, 2: UTF-16BE, 3: UTF-8)."""
    coded = body[:1] and {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0])
    return body[1:].decode(coded or "latin-1", "replace").strip("\0")


def _number(data: bytes, at: int, size: int = 4) -> int | None:
    """A big-endian number, or None beyond the end."""
    return int.from_bytes(data[at: at + size]) if at + size <= len(data) else None


def _table(frame: bytes, side: int) -> dict | None:
    """The variable-bitrate table of a frame; fields that damage has cut off are left out."""
    kind = frame[side: side + 4]
    if kind in (b"Xing", b"Info"):
        flags, at, table = _number(frame, side + 4) or 0, side + 8, {"kind": kind.decode()}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                table[name] = _number(frame, at)
                at += 4
        if flags & 4 and at + 100 <= len(frame):
            table["toc"] = list(frame[at: at + 100])
        return {k: v for k, v in table.items() if v is not None}
    if frame[36: 40] == b"VBRI":
        table = {"kind": "VBRI", "bytes": _number(frame, 46), "frames": _number(frame, 50)}
        entries, scale, size, per = (_number(frame, k, 2) for k in (54, 56, 58, 60))
        if entries and scale and size in (1, 2, 3, 4) and 62 + entries * size <= len(frame):
            steps = [scale * _number(frame, 62 + k * size, size) for k in range(entries)]
            table |= {"frames_per_entry": per, "toc": [sum(steps[:k]) for k in range(entries)]}
        return {k: v for k, v in table.items() if v is not None}
    return None


def _take(out: dict, data: bytes, at: int, head: dict) -> None:
    side = 4 + 2 * head["crc"]
    frame = data[at: at + head["length"]]
    if head["crc"]:
        bits = _protected_bits(frame[6:], head)
        good = 16 + bits <= 8 * len(frame) - 32 and crc16(frame[2: 4] + frame[6: 6 + (bits + 7) // 8], 16 + bits) == _number(frame, 4, 2)
        out["crc_good" if good else "crc_bad"] += 1
    if not out["frames"] and out["table"] is None and head["layer"] == 3:
        out["table"] = _table(frame, side + head["side"])
        if out["table"]:
            return
    out["frames"].append((at, head))


def _frame(kbits: int, room: bytes) -> bytes:
    """A silent protected 48 kHz mono Layer III frame of `kbits` whose free main-data room holds `room`."""
    four = bytes([0xFF, 0xFA, KBITS[True, 3].index(kbits) << 4 | 1 << 2, 0xC0])
    side = bytes(17)
    return (four + crc16(four[2:] + side).to_bytes(2) + side + room).ljust(3 * kbits, b"\0")


ROOM = 3 * 320 - 23
_FIT = [3 * k - 23 for k in KBITS[True, 3][1:]]


def store(payload: bytes) -> bytes:
    """An MPEG-1 Layer III stream with ID3v2 and Xing tables that holds `payload`."""
    frames = [_frame(320, payload[k: k + ROOM]) for k in range(0, len(payload) - ROOM + 1, ROOM)]
    rest = payload[len(frames) * ROOM:]
    if rest:
        frames.append(_frame(KBITS[True, 3][1 + bisect_left(_FIT, len(rest))], rest))
    n, size = len(frames), sum(map(len, frames)) + 3 * 64
    ends, total = [], 0
    for f in frames:
        ends.append(total)
        total += len(f)
    toc = bytes(min(255, 256 * (192 + ends[k * n // 100]) // size) if n else 0 for k in range(100))
    table = b"Xing" + struct.pack(">III", 7, n, size) + toc
    note = b"\3" + str(len(payload)).encode()
    body = b"TXXX" + struct.pack(">IH", len(note) + 1, 0) + note + b"\0"
    tag = b"ID3\3\0\0" + bytes(len(body) >> 7 * k & 0x7F for k in (3, 2, 1, 0)) + body
    made = tag + _frame(64, table) + b"".join(frames)
    return made + b"TAG" + bytes(125) if made[-128: -125] == b"TAG" else made


def load(data: bytes, found: dict) -> bytes:
    """The payload that `store` put into a stream; nothing from a stream that names no length."""
    parts = [data[at + 23: at + h["length"]] for at, h in found["frames"]]
    size = found["tags"].get("TXXX", "")
    return b"".join(parts)[: int(size)] if size.isascii() and size.isdigit() and len(size) < 16 else b""


def payload_of(text: bytes | None) -> bytes:
    """UTF-8 bytes padded with zeros to a positive multiple of 64."""
    data = text or b""
    return data + bytes(-len(data) % 64 if data else 64)


INDEX = "n_frames long, samples long, hertz int, kbits_least int, kbits_most int, crc_good long, crc_bad long, skipped long, table string, tags map<string,string>, seek_offsets array<long>"


def _index_row(found: dict) -> tuple:
    frames = found["frames"]
    kbits = [h["kbits"] for _, h in frames]
    return (len(frames), sum(h["samples"] for _, h in frames), frames[0][1]["hertz"] if frames else None, min(kbits, default=None), max(kbits, default=None),
            found["crc_good"], found["crc_bad"], found["skipped"], (found["table"] or {}).get("kind"), found["tags"], [at for at, _ in frames])


def index_audio(df: DataFrame, media: str = "media", into: str = "audio") -> DataFrame:
    """`df` with a struct column `into`: frame count, exact length in samples and rate, checksums, tables, tags, seek offsets.

    Null media give a null struct; bytes without any frame give zero frames and null rates. A column named `into` is replaced.
    """
    names = [x.split()[0] for x in INDEX.replace("map<string,string>", "map").split(", ")]

    def batch(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_index_row(parse(x)) if x is not None else (None,) * len(names) for x in data], columns=names).astype(
            {k: "Int64" for k in names if k not in ("table", "tags", "seek_offsets")})

    made = F.pandas_udf(batch, INDEX)(F.col(media))
    return df.withColumn(into, F.when(F.col(media).isNotNull(), made))


def store_texts(docs: DataFrame, text: str = "text", into: str = "media") -> DataFrame:
    """`docs` with a binary column `into`: the padded UTF-8 bytes of `text` stored as an MPEG audio stream (null texts: empty).

    Equal texts give equal bytes; repeated rows come back repeated, an empty table gives an empty result, a column `into` is replaced.
    """
    def batch(data: pd.Series) -> pd.Series:
        return pd.Series([store(payload_of(x)) for x in data], dtype=object)

    return docs.withColumn(into, F.pandas_udf(batch, "binary")(F.coalesce(F.col(text).cast("binary"), F.lit(b""))))


DIGESTS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, samples long, hertz int, seek_offsets array<long>"


def audio_digests(df: DataFrame, media: str = "media", into: str = "digest") -> DataFrame:
    """`df` with a struct column of digests of the stored stream and of the payload read back from it.

    feature: layer/rate/channels, frames, samples, checksum counts and a digest of the seek offsets. The exact duration is samples / hertz.
    Media must not be null. Repeated rows come back repeated, an empty table gives an empty result, a column `into` is replaced.
    """
    def batch(data: pd.Series) -> pd.DataFrame:
        rows = []
        for x in data:
            found = parse(x)
            back, frames = load(x, found), found["frames"]
            seeks = hashlib.sha256(struct.pack(f">{len(frames)}q", *[at for at, _ in frames])).hexdigest()[:16]
            h = frames[0][1] if frames else {"layer": 0, "hertz": 0, "mono": True}
            feature = f"layer{h['layer']}/{h['hertz']}/{'mono' if h['mono'] else 'stereo'};frames={len(frames)};samples={sum(f['samples'] for _, f in frames)};crc={found['crc_good']}+{found['crc_bad']};skipped={found['skipped']};seeks={seeks}"
            rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(x), hashlib.sha256(x).hexdigest(), feature,
                         len(frames), sum(f["samples"] for _, f in frames), h["hertz"], [at for at, _ in frames]))
        return pd.DataFrame(rows, columns=[p.split()[0] for p in DIGESTS.split(", ")])

    return df.withColumn(into, F.pandas_udf(batch, DIGESTS)(F.col(media)))
