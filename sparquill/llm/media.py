"""Media columns: motion-JPEG in AVI.

``read_avi`` parses a RIFF AVI by its index; ``decode_frames`` decodes baseline intra frames (any Huffman and quantisation tables, the
standard's where a frame has none, as cameras write them; grey, 4:4:4, 4:2:2 and 4:2:0) to coefficients and samples; ``shots`` cuts a
sequence of frames where the histogram difference passes a threshold that follows the running mean and deviation; ``clips`` gives timed rows.

The Huffman decoder takes all restart intervals of many frames side by side: in each step every interval looks up its next code
in a table of all 16-bit words and takes the bits that the code announces, as array operations over the intervals.

``write_avi`` stores bytes losslessly. JPEG's unit is the quantised coefficient of an 8x8 block, so a payload of
192-byte units makes one MCU of three blocks each. Byte b is the coefficient of magnitude category 8 whose eight
additional bits are b: a number in -255..-128 or 128..255. Every MCU is a restart interval, which keeps DC differences
absolute. Frames hold up to 64 MCUs; where the last frame has room left it is filled with MCUs of zero coefficients, which no payload byte is.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_rows

UNIT = 192
FPS = 25
WIDE, HIGH = 8, 8  # MCUs of a frame, at most
#: Order of a block's coefficients in the stream: along the anti-diagonals, turning at each edge.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_k, _n = np.arange(8)[:, None], np.arange(8)[None, :]
DCT = np.where(_k == 0, np.sqrt(1 / 8), 0.5 * np.cos((2 * _n + 1) * _k * np.pi / 16))
#: Samples of a block from its coefficients in stream order.
IDCT = np.kron(DCT, DCT)[ZIGZAG].astype(np.float32)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(wide: int, high: int) -> bytes:
    counts = bytes([0] * 7 + [2] + [0] * 8)  # two codes, both of eight bits
    return b"".join((
        b"\xff\xd8",
        _segment(0xDB, b"\x00" + b"\x01" * 64),
        _segment(0xC0, struct.pack(">BHHB", 8, high * 8, wide * 8, 3) + bytes([1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0])),
        _segment(0xC4, b"\x00" + counts + b"\x08\x00"),  # DC: category 8, category 0
        _segment(0xC4, b"\x10" + counts + b"\x08\x00"),  # AC: no zeros then category 8, end of block
        _segment(0xDD, b"\x00\x01"),
        _segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])),
    ))


_headers: dict[tuple[int, int], bytes] = {}
BLANK = bytes([1, 1] * 3)  # DC of category 0 and end of block, three times


def _frame(units: np.ndarray, wide: int, high: int) -> bytes:
    n = len(units)
    head = _headers.setdefault((wide, high), _header(wide, high))
    data = np.zeros((n, 2 * UNIT), np.uint8)
    data[:, 1::2] = units
    flat = data.tobytes()
    parts = [flat[i * 2 * UNIT : (i + 1) * 2 * UNIT] for i in range(n)]
    if b"\xff" in flat:
        parts = [p.replace(b"\xff", b"\xff\x00") for p in parts]
    parts += [BLANK] * (wide * high - n)
    out = [head]
    for i, p in enumerate(parts):
        out.append(p)
        if i + 1 < len(parts):
            out.append(b"\xff" + bytes([0xD0 + i % 8]))
    out.append(b"\xff\xd9")
    return b"".join(out)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(payload: bytes) -> bytes:
    """An AVI of motion-JPEG frames with an index whose coefficients are the payload, of a positive multiple of 192 bytes."""
    units = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    wide = min(WIDE, len(units))
    high = min(HIGH, -(-len(units) // wide))
    frames = [_frame(units[i : i + wide * high], wide, high) for i in range(0, len(units), wide * high)]
    largest = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, len(frames), 0, 1, largest, wide * 8, high * 8, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<10I4H", 0, 0, 0, 1, FPS, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, wide * 8, high * 8)
    strf = struct.pack("<IiiHH4sIiiII", 40, wide * 8, high * 8, 1, 24, b"MJPG", wide * high * UNIT, 0, 0, 0, 0)
    hdrl = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        chunk = _chunk(b"00dc", f)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movi.append(chunk)
        at += len(chunk)
    body = b"AVI " + _chunk(b"LIST", hdrl) + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def read_avi(data: bytes) -> dict:
    """fps, width, height and the frames' bytes, by the index (idx1), or by the chunks of movi where there is none."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI")
    found: dict = {"frames": [], "fps": float(FPS), "width": 0, "height": 0}
    movi, index = 0, b""
    stack = [(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))]
    chunks: list[tuple[int, int]] = []
    while stack:
        at, end = stack.pop()
        while at + 8 <= end:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if name == b"LIST":
                if data[at + 8 : at + 12] == b"movi":
                    movi = at + 8
                stack.append((at + 12, min(end, at + 8 + size)))
            elif name == b"avih":
                us, *_, width, height = struct.unpack_from("<10I", data, at + 8)
                found |= {"fps": 1e6 / us if us else float(FPS), "width": width, "height": height}
            elif name == b"idx1":
                index = data[at + 8 : at + 8 + size]
            elif name[2:4] in (b"dc", b"db"):
                chunks.append((at + 8, size))
            at += 8 + size + (size & 1)
    if index:
        rows = [struct.unpack_from("<4sIII", index, i) for i in range(0, len(index) - 15, 16)]
        base = movi if rows and data[movi + rows[0][2] : movi + rows[0][2] + 4] == rows[0][0] else 0
        chunks = [(base + off + 8, size) for name, _, off, size in rows if name[2:4] in (b"dc", b"db")]
    found["frames"] = [data[a : a + n] for a, n in chunks]
    return found


def _rest(head: str) -> bytes:
    """A list of AC symbols that ends with all others in order: runs of 0 to 15 with sizes of 1 to 10."""
    first = bytes.fromhex(head)
    return first + bytes(s for s in (16 * r + n for r in range(16) for n in range(1, 11)) if s not in first)


#: The Huffman tables of the JPEG standard, as (codes of each length, symbols) by class and number.
STANDARD = {
    0x00: (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12))),
    0x01: (bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]), bytes(range(12))),
    0x10: (bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]), _rest("01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82")),
    0x11: (bytes([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]), _rest("00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1")),
}
RESTART = re.compile(rb"\xff[\xd0-\xd7]")
_tables: dict[tuple[bytes, bytes], np.ndarray] = {}


def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16-bit word, 256 times the length of the code that it begins with, and the code's symbol; 0 where there is none."""
    if (counts, symbols) not in _tables:
        table, code, i = np.zeros(1 << 16, np.int32), 0, 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbols[i]
                code, i = code + 1, i + 1
            code <<= 1
        if len(_tables) > 64:
            _tables.clear()
        _tables[counts, symbols] = table
    return _tables[counts, symbols]


def _parse(frame: bytes) -> dict:
    """Tables, size, components and scan of a baseline JPEG."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("no JPEG frame")
    got: dict = {"quant": {}, "huff": dict(STANDARD), "restart": 0}
    at = 2
    while at + 4 <= len(frame):
        if frame[at] != 0xFF:
            raise ValueError("no marker where one is due")
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        if marker == 0xFF:  # a fill byte
            at += 1
            continue
        body = frame[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                got["quant"][body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.float32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                got["huff"][body[0]] = (bytes(body[1:17]), bytes(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            bits, got["height"], got["width"], n = struct.unpack_from(">BHHB", body)
            if bits != 8:
                raise ValueError("samples of other than eight bits")
            got["parts"] = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif marker == 0xDD:
            got["restart"] = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            if "parts" not in got or body[0] != len(got["parts"]):
                raise ValueError("a scan of some components")
            got["scan"] = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            end = frame.rfind(b"\xff\xd9")
            got["data"] = frame[at : end if end >= at else len(frame)]
            return got | _layout(got)
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("not baseline")
    raise ValueError("no scan")


def _layout(got: dict) -> dict:
    """How a frame's blocks follow each other: MCUs, and for each block of an MCU its component and the tables of its scan."""
    parts = got["parts"]
    if not got["width"] or not got["height"] or any(not 1 <= f <= 4 for p in parts for f in p[1:3]):
        raise ValueError("a frame without size")
    if len(parts) == 1:  # not interleaved: one block is a unit, whatever the factors
        parts = [(parts[0][0], 1, 1, parts[0][3])]
    wide, high = max(p[1] for p in parts), max(p[2] for p in parts)
    order = [c for c, (_, h, v, _) in enumerate(parts) for _ in range(h * v)]
    return {"parts": parts, "mcus": -(-got["width"] // (8 * wide)) * -(-got["height"] // (8 * high)), "order": order}


def _lanes(frames: list[dict]) -> tuple[bytes, list]:
    """The restart intervals of some frames as bytes without stuffing, each followed by zeros, and (frame, offset, length, blocks) of each."""
    pieces, lanes, at = [], [], 0
    for f, got in enumerate(frames):
        parts = RESTART.split(got["data"]) if got["restart"] else [got["data"]]
        left = got["mcus"]
        for part in parts:
            mcus = min(left, got["restart"] or left)
            if not mcus:
                break
            raw = part.replace(b"\xff\x00", b"\xff") if b"\xff" in part else part
            pieces += (raw, b"\0" * 8)
            lanes.append((f, at, len(raw), mcus * len(got["order"])))
            at += len(raw) + 8
            left -= mcus
        if left:
            raise ValueError("a scan that ends early")
    return b"".join(pieces), lanes


def decode_coefficients(frames: list[dict]) -> list[np.ndarray]:
    """Quantised coefficients (blocks x 64, stream order, MCU by MCU) of each parsed frame."""
    buffer, lanes = _lanes(frames)
    data = np.frombuffer(buffer + b"\0" * 8, np.uint8).astype(np.int64)
    words = sum(data[i : len(data) - 4 + i] << (8 * (4 - i)) for i in range(5))  # the 40 bits from each byte on
    sorts: dict[tuple, int] = {}
    kinds: list[list[int]] = []  # for each sort of frame the number of the table pair of each block of an MCU
    pairs: dict[tuple, int] = {}
    for got in frames:
        of = [(got["huff"].get(got["scan"].get(got["parts"][c][0], 0) >> 4), got["huff"].get(16 | got["scan"].get(got["parts"][c][0], 0) & 15)) for c in got["order"]]
        if any(t is None for p in of for t in p):
            raise ValueError("a scan without its table")
        own = tuple(pairs.setdefault(p, len(pairs)) for p in of)
        got["sort"] = sorts.setdefault(own, len(sorts))
        if got["sort"] == len(kinds):
            kinds.append(list(own))
    tables = np.concatenate([_lookup(*t) for p in pairs for t in p])  # DC and AC of each pair
    longest = max(map(len, kinds))
    schedule = np.array([(k * longest)[:longest] for k in kinds])
    per_mcu = np.array([len(k) for k in kinds])
    frame, offset, size, blocks = (np.array(c, np.int64) for c in zip(*lanes, strict=True))
    sort = np.array([got["sort"] for got in frames])[frame]
    first = np.concatenate(([0], np.cumsum(blocks)))[:-1]  # number of each lane's first block
    out = np.zeros((int(blocks.sum()), 64), np.int32)
    flat = out.reshape(-1)
    lane = np.arange(len(lanes))
    pos, block, k = np.zeros((3, len(lanes)), np.int64)
    while len(lane):
        table = schedule[sort[lane], block % per_mcu[sort[lane]]] * 2 + (k > 0)
        byte = np.minimum(pos >> 3, size[lane] + 3)
        word = words[offset[lane] + byte]
        room = 40 - (pos & 7)
        entry = tables[(table << 16) + ((word >> (room - 16)) & 0xFFFF)]
        length, symbol = entry >> 8, entry & 255
        if not length.all() or (pos >= 8 * size[lane]).any():
            raise ValueError("no such code")
        dc = k == 0
        bits = np.where(dc, symbol, symbol & 15)
        value = (word >> (room - length - bits)) & ((1 << bits) - 1)
        value -= np.where((bits > 0) & (value >> np.maximum(bits - 1, 0) == 0), (1 << bits) - 1, 0)
        k = k + np.where(dc, 0, symbol >> 4)
        if (k > 63 + 16).any() or ((k > 63) & (bits > 0)).any() or (bits > 15).any():
            raise ValueError("a block with too many coefficients")
        some = bits > 0
        flat[((first[lane] + block) * 64 + k)[some]] = value[some]
        ends = ~dc & (bits == 0) & (symbol != 0xF0)
        pos = pos + length + bits
        k = k + 1
        done = ends | (k > 63)
        block, k = block + done, np.where(done, 0, k)
        going = block < blocks[lane]
        if not going.all():
            lane, pos, block, k = lane[going], pos[going], block[going], k[going]
    _undo_differences(out, first, blocks, [got["order"] for got in frames], frame)
    edges = np.cumsum([got["mcus"] * len(got["order"]) for got in frames])
    return np.split(out, edges[:-1])


def _undo_differences(out: np.ndarray, first: np.ndarray, blocks: np.ndarray, orders: list[list[int]], frame: np.ndarray) -> None:
    """DC values from their differences: sums over the blocks of a component in a restart interval, in place."""
    lane = np.repeat(np.arange(len(blocks)), blocks)
    within = np.arange(len(out)) - first[lane]
    longest = max(map(len, orders))
    order = np.array([(o * longest)[:longest] for o in orders])
    component = order[frame[lane], within % np.array([len(o) for o in orders])[frame[lane]]]
    by = np.lexsort((within, component, lane))
    total = np.cumsum(out[by, 0], dtype=np.int64)
    new = np.concatenate(([True], (lane[by][1:] != lane[by][:-1]) | (component[by][1:] != component[by][:-1])))
    starts = np.flatnonzero(new)
    before = np.where(starts > 0, total[starts - 1], 0)
    out[by, 0] = total - np.repeat(before, np.diff(np.append(starts, len(by))))


def decode_frames(frames: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Quantised coefficients (blocks x 64, stream order, MCU by MCU) and the first component's samples (blocks x 64, 0..255) of frames."""
    parsed = [_parse(f) for f in frames]
    out = []
    for got, c in zip(parsed, decode_coefficients(parsed) if parsed else [], strict=True):
        first = c.reshape(got["mcus"], -1, 64)[:, [o == 0 for o in got["order"]]].reshape(-1, 64)
        table = got["quant"].get(got["parts"][0][3])
        if table is None:
            raise ValueError("no quantisation table")
        samples = (first * table).astype(np.float32) @ IDCT + 128
        out.append((c, np.clip(np.rint(samples), 0, 255).astype(np.uint8)))
    return out


def payload_of(coefficients: np.ndarray) -> bytes:
    """The bytes that ``write_avi`` stored in a frame's coefficients."""
    own = coefficients.reshape(-1, UNIT)
    own = own[own[:, 0] != 0]
    return np.where(own > 0, own, own + 255).astype(np.uint8).tobytes()


def histogram(samples: np.ndarray) -> np.ndarray:
    """Shares of 32 brightness classes among a frame's samples."""
    n = np.bincount(samples.ravel() >> 3, minlength=32)
    return n / max(1, n.sum())


def shots(histograms: list[np.ndarray], weight: float = 0.3, factor: float = 3.0, least: float = 0.25) -> list[int]:
    """First frames of the shots: a cut is a histogram difference over ``least`` and over the running mean by ``factor`` running
    deviations; both follow the differences at rate ``weight`` and start anew after a cut."""
    cuts, mean, spread = [0] if histograms else [], None, 0.0
    for i in range(1, len(histograms)):
        d = float(np.abs(histograms[i] - histograms[i - 1]).sum() / 2)
        if d > least and (mean is None or d > mean + factor * max(spread, 0.02)):
            cuts.append(i)
            mean, spread = None, 0.0
        elif mean is None:
            mean = d
        else:
            spread += weight * (abs(d - mean) - spread)
            mean += weight * (d - mean)
    return cuts


def analyse(videos: list[bytes]) -> list[tuple[bytes, list[tuple[int, float, float, float]]]]:
    """Stored bytes of each AVI and its clips: (first frame, from second, to second, mean brightness). All frames are decoded together."""
    read = [read_avi(v) for v in videos]
    frames = iter(decode_frames([f for v in read for f in v["frames"]]))
    out = []
    for video in read:
        own = [next(frames) for _ in video["frames"]]
        tables, light = [histogram(s) for _, s in own], [float(s.mean()) for _, s in own]
        cuts = shots(tables)
        found = [(a, a / video["fps"], b / video["fps"], sum(light[a:b]) / (b - a)) for a, b in zip(cuts, [*cuts[1:], len(tables)], strict=False)]
        out.append((b"".join(payload_of(c) for c, _ in own if len(c) % 3 == 0), found))
    return out


def grouped(items: list, size: int = 1 << 20) -> Iterator[list]:
    """``items`` in runs of about ``size`` bytes."""
    held, n = [], 0
    for i in items:
        held.append(i)
        n += len(i or b"")
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def padded(text: bytes | None) -> bytes:
    raw = text or b""
    return raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b" ")


def clips(videos: DataFrame, id_col: str, video_col: str) -> DataFrame:
    """Clip rows of AVI files: id, clip, first_frame, begin_s, end_s, brightness, error.

    A file that cannot be read has one row with nothing but its id and why. A null file and one without frames have none. Repeated
    rows have rows each; an empty table has none; other columns are not read, whatever their names. Files are read whole.
    """

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data in byte_rows(batches, rows=32):
            rows = []
            for i, d in zip(part.column(0).to_pylist(), data, strict=True):
                try:
                    found = analyse([d])[0][1] if d is not None else []
                except (ValueError, struct.error, KeyError, IndexError) as why:
                    rows.append((i, None, None, None, None, None, str(why) or type(why).__name__))
                    continue
                rows += [(i, k, *c, None) for k, c in enumerate(found)]
            names = [id_col, "clip", "first_frame", "begin_s", "end_s", "brightness", "error"]
            types = [part.column(0).type, pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.string()]
            yield pa.record_batch([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], names=names)

    kind = videos.schema[id_col].dataType.simpleString()
    return videos.select(id_col, video_col).mapInArrow(give, f"`{id_col}` {kind}, clip int, first_frame int, begin_s double, end_s double, brightness double, error string")


def to_avi(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, video): each text's AVI."""

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in byte_rows(batches, rows=64):
            yield pa.record_batch([part.column(0), pa.array([write_avi(padded(t)) for t in texts], pa.binary())], names=[id_col, "video"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("binary").alias("__text")).mapInArrow(give, f"`{id_col}` {kind}, video binary")


def stored_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as an AVI, read it back, and give the figures of both; one row a document.

    Null and empty texts are one unit of spaces; long texts are stored whole. An empty table gives no rows. feature: frames, shots and for each of the first shot to the last its first
    frame and brightness. Repeated rows are kept. Only the two columns are read.
    """

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in byte_rows(batches, rows=256):
            rows = []
            videos = ((t, v, *got) for some in grouped(texts) for written in [[write_avi(padded(t)) for t in some]] for t, v, got in zip(some, written, analyse(written), strict=True))
            for t, video, back, found in videos:
                feature = f"shots={len(found)};" + ";".join(f"{a}:{light:.2f}" for a, _, _, light in found)
                rows.append((len(t or b""), len(back), hashlib.sha256(back).hexdigest(), crc32(back[-16:]), len(video), hashlib.sha256(video).hexdigest(), feature))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.record_batch([part.column(0), *(pa.array([r[j] for r in rows], t) for j, t in enumerate(types))], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(id_col, F.col(text_col).cast("binary").alias("__text")).mapInArrow(give, schema)
