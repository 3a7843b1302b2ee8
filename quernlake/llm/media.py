"""AVI motion-JPEG columns: frames by the RIFF indexes, baseline JPEG decoding, shots as timed clip rows."""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- JPEG ------------------------------------------------------------------------------------------------

ZIGZAG = np.array([0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63])
_DCT = np.array([[(0.5 if u else np.sqrt(0.125)) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
_DCT32 = _DCT.astype(np.float32)
# the standard's Huffman tables, which motion JPEG may leave out: (codes of each length, symbols)
_DC = (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12)))
_DC_C = (bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]), bytes(range(12)))
_AC = (
    bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]),
    bytes.fromhex("01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"),
)
_AC_C = (
    bytes([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]),
    bytes.fromhex("0001020311040521310612415107617113223281081442 91a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa".replace(" ", "")),
)
DEFAULT = {(0, 0): _DC, (0, 1): _DC_C, (1, 0): _AC, (1, 1): _AC_C}


@lru_cache(maxsize=64)
def _codes(table: tuple[bytes, bytes]) -> dict[int, tuple[int, int]]:
    """Symbol -> (code, length)."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(table[0], 1):
        for _ in range(n):
            if code >> length:
                raise BadImage("bad Huffman table")
            out[table[1][at]] = (code, length)
            code, at = code + 1, at + 1
        code <<= 1
    return out


@lru_cache(maxsize=64)
def _lookup(table: tuple[bytes, bytes]) -> list[int]:
    """For each 16 bits ahead: length * 256 + symbol, 0 where no code begins so."""
    out = [0] * 65536
    for symbol, (code, length) in _codes(table).items():
        low = code << (16 - length)
        out[low : low + (1 << (16 - length))] = [length << 8 | symbol] * (1 << (16 - length))
    return out


PIXELS = 1 << 26  # a frame that claims more is damaged


class BadImage(ValueError):
    pass


def _scan(data: bytes, components: list, mcus: int, restart: int) -> list[array]:
    """Coefficients (64 a block, in zigzag order) of each component's blocks, in MCU order.  Bits are read from a window
    of some bytes, so that the time is in proportion to the data."""
    if 2 * mcus * sum(blocks for blocks, _, _ in components) > 8 * len(data):  # a block has two codes
        raise BadImage("cut off")
    out = [array("h", bytes(2 * 64 * mcus * blocks)) for blocks, _, _ in components]
    base, left = [0] * len(components), mcus
    for part in _split(data, restart):
        limit, part = 8 * len(part), part + b"\xff" * 16
        window = have = pos = 0
        last = [0] * len(components)
        for _ in range(min(left, restart or left)):
            for k, (blocks, dc, ac) in enumerate(components):
                coef, begin = out[k], base[k]
                base[k] += 64 * blocks
                for _ in range(blocks):
                    if have < 32:
                        window = (window & (1 << have) - 1) << 48 | int.from_bytes(part[pos : pos + 6], "big")
                        have, pos = have + 48, pos + 6
                    code = dc[window >> have - 16 & 0xFFFF]
                    if not code:
                        raise BadImage("bad Huffman code")
                    have -= code >> 8
                    size = code & 255
                    if size:
                        if size > 15:
                            raise BadImage("bad Huffman code")
                        have -= size
                        v = window >> have & (1 << size) - 1
                        last[k] += v if v >> size - 1 else v - (1 << size) + 1
                    if not -32768 <= last[k] <= 32767:
                        raise BadImage("bad coefficient")
                    coef[begin] = last[k]
                    at = 1
                    while at < 64:
                        if have < 32:
                            window = (window & (1 << have) - 1) << 48 | int.from_bytes(part[pos : pos + 6], "big")
                            have, pos = have + 48, pos + 6
                        code = ac[window >> have - 16 & 0xFFFF]
                        if not code:
                            raise BadImage("bad Huffman code")
                        have -= code >> 8
                        size = code & 15
                        if not size:
                            if code & 255 != 0xF0:
                                break
                            at += 16
                            continue
                        at += code >> 4 & 15
                        if at > 63:
                            raise BadImage("too many coefficients")
                        have -= size
                        v = window >> have & (1 << size) - 1
                        coef[begin + at] = v if v >> size - 1 else v - (1 << size) + 1
                        at += 1
                    if 8 * pos - have > limit:
                        raise BadImage("cut off")
                    begin += 64
        left -= restart or left
        if left <= 0:
            break
    if left > 0:
        raise BadImage("cut off")
    return out


def _split(data: bytes, restart: int) -> list[bytes]:
    """Entropy-coded intervals between restart markers, without stuffing."""
    parts, at, begin = [], 0, 0
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            parts.append(data[begin:] if at < 0 else data[begin:at])
            break
        mark = data[at + 1]
        if mark == 0:
            at += 2
        elif mark == 0xFF:
            at += 1
        elif 0xD0 <= mark <= 0xD7 and restart:
            parts.append(data[begin:at])
            at = begin = at + 2
        else:
            parts.append(data[begin:at])
            break
    return [p.replace(b"\xff\x00", b"\xff") for p in parts]


def _segments(data: bytes) -> Iterator[tuple[int, bytes, int]]:
    """(marker, content, where it ends) of a JPEG's segments; after a scan's data comes the next marker."""
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            at = data.find(b"\xff", at)
            if at < 0:
                return
            continue
        mark = data[at + 1]
        if mark in (0x00, 0xFF, 0x01) or 0xD0 <= mark <= 0xD8:
            at += 1 if mark == 0xFF else 2
            continue
        if mark == 0xD9:
            return
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if size < 2:
            raise BadImage("bad segment")
        yield mark, data[at + 4 : at + 2 + size], at + 2 + size
        at += 2 + size


def decode_jpeg(data: bytes) -> np.ndarray:
    """Height x width x 3 (Y, Cb, Cr) of a baseline JPEG; chroma of a gray one is 128.  Components may come in one
    scan or in one each.  What can't be decoded is a :class:`BadImage`."""
    try:
        return _decode(data)
    except BadImage:
        raise
    except (LookupError, ArithmeticError, ValueError, struct.error) as e:
        raise BadImage(f"damaged: {e}") from None


def _decode(data: bytes) -> np.ndarray:
    if data[:2] != b"\xff\xd8":
        raise BadImage("no JPEG")
    quant, huff, restart = {}, dict(DEFAULT), 0
    frame: dict[int, tuple[int, int, int]] = {}  # horizontal and vertical sampling and quantisation table of a component
    planes: dict[int, np.ndarray] = {}
    height = width = hmax = vmax = across = down = 0
    for mark, body, at in _segments(data):
        if mark == 0xDB:
            while body:
                wide, k = body[0] >> 4, body[0] & 15
                quant[k] = np.frombuffer(body[1 : 1 + 64 * (wide + 1)], ">u2" if wide else "u1").astype(np.float32)
                body = body[1 + 64 * (wide + 1) :]
        elif mark == 0xC4:
            while body:
                n = sum(body[1:17])
                huff[body[0] >> 4, body[0] & 15] = (bytes(body[1:17]), bytes(body[17 : 17 + n]))
                body = body[17 + n :]
        elif mark in (0xC0, 0xC1):
            depth, height, width, n = struct.unpack(">BHHB", body[:6])
            frame = {body[6 + 3 * k]: (body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)}
            if height * width > PIXELS:
                raise BadImage("too large")
            if depth != 8 or len(frame) != n or n not in (1, 3, 4) or not all(1 <= h <= 4 and 1 <= v <= 4 for h, v, _ in frame.values()) or not height or not width:
                raise BadImage("no frame of 8 bits")
            if n == 1:
                frame = {c: (1, 1, q) for c, (_, _, q) in frame.items()}
            hmax, vmax = max(h for h, _, _ in frame.values()), max(v for _, v, _ in frame.values())
            across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
            if any(hmax % h or vmax % v for h, v, _ in frame.values()):
                raise BadImage("uneven sampling")
        elif 0xC2 <= mark <= 0xCF and mark != 0xC8 and mark != 0xCC:
            raise BadImage("not a baseline JPEG")
        elif mark == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif mark == 0xDA:
            if not frame:
                raise BadImage("no frame")
            chosen = {body[1 + 2 * k]: (body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])}
            if planes.keys() & chosen.keys():
                raise BadImage("a component comes twice")
            parts = [(frame[c], _lookup(huff[0, d]), _lookup(huff[1, a])) for c, (d, a) in chosen.items()]
            if len(chosen) == 1:  # a single component isn't interleaved: its blocks come row by row
                (c,) = chosen
                h, v, q = frame[c]
                wide, high = -(-(-(-width * h // hmax)) // 8), -(-(-(-height * v // vmax)) // 8)
                (blocks,) = _scan(data[at:], [(1, *parts[0][1:])], wide * high, restart)
                planes[c] = _plane(blocks, quant[q], high, wide, 1, 1)
            else:
                found = _scan(data[at:], [(h * v, dc, ac) for (h, v, _), dc, ac in parts], across * down, restart)
                planes |= {c: _plane(x, quant[q], down, across, v, h) for c, x, ((h, v, q), _, _) in zip(chosen, found, parts)}
            if len(planes) == len(frame):
                break
    if not frame or list(frame)[0] not in planes:
        raise BadImage("no scan")
    out = np.full((height, width, 3), 128, np.uint8)
    for k, c in enumerate(list(frame)[:3]):
        if c in planes:
            h, v, _ = frame[c]
            out[:, :, k] = planes[c].repeat(vmax // v, axis=0).repeat(hmax // h, axis=1)[:height, :width]
    return out


def _plane(blocks: array, quant: np.ndarray, down: int, across: int, v: int, h: int) -> np.ndarray:
    """Pixels of a component from the coefficients of its down x across groups of v x h blocks."""
    given = np.frombuffer(blocks, np.int16).reshape(-1, 64)
    pixel = np.empty((len(given), 8, 8), np.uint8)
    for k in range(0, len(given), 4096):
        coef = np.zeros((len(given[k : k + 4096]), 64), np.float32)
        coef[:, ZIGZAG] = given[k : k + 4096] * quant
        pixel[k : k + 4096] = np.clip(np.rint(_DCT32.T @ coef.reshape(-1, 8, 8) @ _DCT32 + 128), 0, 255)
    return pixel.reshape(down, across, v, h, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(down * v * 8, across * h * 8)


def encode_jpeg(image: np.ndarray, quality: int = 8, tables: bool = False, restart: int = 0) -> bytes:
    """Baseline JPEG, 4:2:0, of height x width x 3 (Y, Cb, Cr); motion JPEG omits the Huffman tables.  ``restart``: MCUs
    between restart markers.  Makes the fixtures."""
    shape = image.shape[:2]
    image = np.pad(image, ((0, -shape[0] % 16), (0, -shape[1] % 16), (0, 0)), mode="edge")
    height, width, _ = image.shape
    q = np.full(64, quality, float)
    y = image[:, :, 0].astype(float)
    chroma = [image[:, :, k].astype(float).reshape(height // 2, 2, width // 2, 2).mean(axis=(1, 3)) for k in (1, 2)]
    coef = []
    for plane, n in ((y, 2), (chroma[0], 1), (chroma[1], 1)):
        b = (plane - 128).reshape(height // 16, n, 8, width // 16, n, 8).transpose(0, 3, 1, 4, 2, 5).reshape(-1, n * n, 8, 8)
        coef.append(np.rint((_DCT @ b @ _DCT.T).reshape(-1, n * n, 64)[:, :, ZIGZAG] / q).astype(int).tolist())
    value, bits, last = 0, 0, [0, 0, 0]
    dc = [_codes(_DC), _codes(_DC_C), _codes(_DC_C)]
    ac = [_codes(_AC), _codes(_AC_C), _codes(_AC_C)]

    def put(code: int, length: int) -> None:
        nonlocal value, bits
        value, bits = value << length | code, bits + length

    def number(v: int, size: int) -> int:
        return v if v > 0 else v + (1 << size) - 1

    def flush() -> bytes:
        nonlocal value, bits
        pad = -bits % 8
        whole = ((value << pad) | ((1 << pad) - 1)).to_bytes((bits + pad) // 8, "big").replace(b"\xff", b"\xff\x00")
        value = bits = 0
        return whole

    body = b""
    for mcu in range(len(coef[0])):
        if restart and mcu and mcu % restart == 0:
            body += flush() + bytes([0xFF, 0xD0 + (mcu // restart - 1) % 8])
            last = [0, 0, 0]
        for k in range(3):
            for block in coef[k][mcu]:
                d, last[k] = block[0] - last[k], block[0]
                size = abs(d).bit_length()
                put(*dc[k][size])
                if size:
                    put(number(d, size), size)
                run = 0
                end = max((j for j in range(1, 64) if block[j]), default=0)
                for v in block[1 : end + 1]:
                    if not v:
                        run += 1
                        continue
                    while run > 15:
                        put(*ac[k][0xF0])
                        run -= 16
                    size = abs(v).bit_length()
                    put(*ac[k][run << 4 | size])
                    put(number(v, size), size)
                    run = 0
                if end < 63:
                    put(*ac[k][0])
    body += flush()

    def segment(mark: int, content: bytes) -> bytes:
        return bytes([0xFF, mark]) + struct.pack(">H", len(content) + 2) + content

    out = b"\xff\xd8" + segment(0xDB, b"\0" + bytes([quality] * 64))
    out += segment(0xC0, struct.pack(">BHHB", 8, *shape, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    if restart:
        out += segment(0xDD, struct.pack(">H", restart))
    if tables:
        for (c, k), (counts, symbols) in DEFAULT.items():
            out += segment(0xC4, bytes([c << 4 | k]) + counts + symbols)
    return out + segment(0xDA, bytes([3, 1, 0, 2, 0x11, 3, 0x11, 0, 63, 0])) + body + b"\xff\xd9"


# ---- AVI -------------------------------------------------------------------------------------------------


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        yield data[at : at + 4], at + 8, min(at + 8 + size, end)
        at += 8 + size + (size & 1)


class Avi:
    """Frames of the first video stream: ``frames`` as (offset, end), ``microseconds`` a frame.  An index that tells of
    more bytes than there are is damaged; then, and without one, the chunks count in turn."""

    def __init__(self, data: bytes):
        if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
            raise BadImage("no AVI")
        self.microseconds, self.stream, handler = 40000, 0, b"MJPG"
        index, movi, standard = None, [], []
        n = 0
        for riff, a, b in _chunks(data, 0, len(data)):
            if riff != b"RIFF":
                continue
            for name, c, d in _chunks(data, a + 4, b):
                kind = data[c : c + 4]
                if name == b"LIST" and kind == b"hdrl":
                    for x, e, f in _chunks(data, c + 4, d):
                        if x == b"avih":
                            self.microseconds = int.from_bytes(data[e : e + 4], "little") or self.microseconds
                        elif x == b"LIST" and data[e : e + 4] == b"strl":
                            video = False
                            for y, g, h in _chunks(data, e + 4, f):
                                if y == b"strh" and data[g : g + 4] == b"vids" and self.stream == n:
                                    video, handler = True, data[g + 4 : g + 8]
                                    scale, rate = (int.from_bytes(data[k : k + 4], "little") for k in (g + 20, g + 24))
                                    if scale and rate:
                                        self.microseconds = scale * 1e6 / rate
                                elif y == b"strh" and self.stream == n:
                                    self.stream += 1
                                elif y == b"indx" and video:
                                    standard.append((g, h))
                            n += 1
                elif name == b"LIST" and kind == b"movi":
                    movi.append((c, d))
                elif name == b"idx1":
                    index = (c, d)
        if handler.upper() not in (b"MJPG", b"\0\0\0\0", b"AVRN", b"LJPG"):
            raise BadImage("not motion JPEG")
        ids = {b"%02d" % self.stream + x for x in (b"dc", b"db")}
        self.data, self.frames = data, []
        for found in (self._indx(standard), self._idx1(index, movi[0][0], ids) if index and movi else [], self._walk(movi, ids)):
            size = sum(max(0, end - begin) for begin, end in dict.fromkeys(found))
            if found and size <= len(data):
                self.frames = found
                break

    def _walk(self, movi: list[tuple[int, int]], ids: set[bytes]) -> Iterator[tuple[int, int]]:
        todo = [_chunks(self.data, c + 4, d) for c, d in reversed(movi)]
        out = []
        while todo:
            name, c, d = next(todo[-1], (None, 0, 0))
            if name is None:
                todo.pop()
            elif name in ids:
                out.append((c, d))
            elif name == b"LIST" and self.data[c : c + 4] == b"rec ":
                todo.append(_chunks(self.data, c + 4, d))
        return out

    def _idx1(self, index: tuple[int, int], movi: int, ids: set[bytes]) -> list[tuple[int, int]]:
        data = self.data
        rows = [struct.unpack("<4sIII", data[k : k + 16]) for k in range(index[0], index[1] - 15, 16)]
        rows = [r for r in rows if r[0] in ids]
        if not rows:
            return []
        # offsets count from the list's name, or from the file's start
        base = movi if data[movi + rows[0][2] : movi + rows[0][2] + 4] in ids else 0
        return [(base + o + 8, min(len(data), base + o + 8 + size)) for _, _, o, size in rows]

    def _indx(self, todo: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Frames of OpenDML indexes; an index of indexes leads to standard ones only, to each once."""
        data, out, seen = self.data, [], set()
        for a, b in todo:
            if data[a + 3 : a + 4] != b"\0":
                out += self._standard(a, b)
                continue
            used = min(int.from_bytes(data[a + 4 : a + 8], "little"), (b - a - 24) // 16)
            for at in range(a + 24, a + 24 + 16 * used, 16):
                offset = int.from_bytes(data[at : at + 8], "little")
                if offset not in seen and offset + 8 <= len(data) and data[offset + 11 : offset + 12] == b"\1":
                    seen.add(offset)
                    out += self._standard(offset + 8, min(len(data), offset + 8 + int.from_bytes(data[offset + 4 : offset + 8], "little")))
                if len(out) > len(data) // 8:  # a frame has a header of eight bytes
                    return []
        return out

    def _standard(self, a: int, b: int) -> list[tuple[int, int]]:
        data = self.data
        width, used = 4 * int.from_bytes(data[a : a + 2], "little"), int.from_bytes(data[a + 4 : a + 8], "little")
        if width < 8:
            return []
        base = int.from_bytes(data[a + 12 : a + 20], "little")
        out = []
        for at in range(a + 24, a + 24 + width * max(0, min(used, (b - a - 24) // width)), width):
            offset, size = struct.unpack("<II", data[at : at + 8])
            out.append((min(len(data), base + offset), min(len(data), base + offset + (size & 0x7FFFFFFF))))
        return out


def write_avi(frames: list[bytes], microseconds: int, width: int, height: int, index: str = "idx1") -> bytes:
    """An AVI with an ``idx1`` index, OpenDML indexes (``indx``, of some frames each) or none.  Makes the fixtures."""

    def chunk(name: bytes, body: bytes) -> bytes:
        return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)

    parts = [frames[k : k + 5] for k in range(0, len(frames), 5)] if index == "indx" else [frames]
    avih = struct.pack("<14I", microseconds, 0, 0, 0x10, len(frames), 0, 1, 0, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, microseconds, 1000000, 0, len(frames), 0, 0, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", 0, 0, 0, 0, 0)

    def head(places: list[int]) -> bytes:
        indx = chunk(b"indx", struct.pack("<HBBI4s12x", 4, 0, 0, len(places), b"00dc") + b"".join(struct.pack("<QII", p, 0, 0) for p in places)) if index == "indx" else b""
        return chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf) + indx))

    begin = 12 + len(head([0] * len(parts)))  # of the list of frames
    movi, old, places = b"movi", b"", []
    for part in parts:
        entries = b""
        for f in part:
            old += struct.pack("<4sIII", b"00dc", 0x10, len(movi), len(f))
            entries += struct.pack("<II", begin + 8 + len(movi) + 8, len(f))
            movi += chunk(b"00dc", f)
        if index == "indx":
            places.append(begin + 8 + len(movi))
            movi += chunk(b"ix00", struct.pack("<HBBI4sQ4x", 2, 0, 1, len(part), b"00dc", 0) + entries)
    return chunk(b"RIFF", b"AVI " + head(places) + chunk(b"LIST", movi) + (chunk(b"idx1", old) if index == "idx1" else b""))


# ---- shots -----------------------------------------------------------------------------------------------

WINDOW, FACTOR, NOISE, ALONE = 8, 3.0, 0.02, 0.35


def _soft(width: int) -> np.ndarray:
    """Share of each of 256 levels in bins of a width: a level between the middles of two bins counts in both."""
    middle = np.arange(width / 2 - 0.5, 256, width)
    return np.array([np.interp(np.arange(256), middle, one) for one in np.eye(len(middle))]).T


_BINS = [_soft(width) for width in (16, 32, 32)]
_PARTS = np.cumsum([x.shape[1] for x in _BINS])[:-1]


def histogram(image: np.ndarray) -> np.ndarray:
    """Shares of pixels by luma (16 levels) and chroma (8 and 8), each summing to one."""
    n = image.shape[0] * image.shape[1]
    return np.concatenate([np.bincount(image[:, :, k].ravel(), minlength=256) @ x for k, x in enumerate(_BINS)]) / n


def cuts(histograms: np.ndarray) -> list[int]:
    """Frames at which a shot begins (frame 0 not counted): the difference from the frame before, in the channel that
    changes most, is the greatest nearby and above the mean of the calm ones nearby by a multiple of their deviation,
    which is taken as ``NOISE`` at least.  Calm is what is not far from the median, so that other cuts don't count."""
    if len(histograms) < 2:
        return []
    d = np.max([np.abs(x).sum(axis=1) / 2 for x in np.split(np.diff(histograms, axis=0), _PARTS, axis=1)], axis=0)
    out = []
    for k in np.flatnonzero(d > FACTOR * NOISE):
        near = np.r_[d[max(0, k - WINDOW) : k], d[k + 1 : k + 1 + WINDOW]]
        if len(near):
            middle = np.median(near)
            calm = near[near <= middle + FACTOR * max(1.4826 * np.median(np.abs(near - middle)), NOISE)]
            bound = calm.mean() + FACTOR * max(calm.std(), NOISE)
        else:
            bound = ALONE
        beside = max(d[k - 1] if k else 0, d[k + 1] if k + 1 < len(d) else 0)
        if d[k] > bound and d[k] >= beside:
            out.append(int(k) + 1)
    return out


def clips(media: bytes | None) -> list[tuple[int, float, float, int, float]]:
    """(clip, start ms, end ms, frames, mean luma) of the shots of a file; none of what isn't motion-JPEG AVI."""
    if not media:
        return []
    try:
        avi = Avi(media)
    except (BadImage, struct.error, LookupError):
        return []
    shown, known = [], []
    done: dict[tuple[int, int], tuple[np.ndarray, float] | None] = {}  # an index may name a frame again
    for k, span in enumerate(avi.frames):  # each frame of motion JPEG is whole, whatever its flag
        if span not in done:
            try:
                image = decode_jpeg(media[span[0] : span[1]])
                done[span] = histogram(image), float(image[:, :, 0].mean())
            except BadImage:
                done[span] = None  # a damaged frame shows what was before it
        if done[span]:
            shown.append(k)
            known.append(done[span])
    if not known:
        return []
    edges = [0, *cuts(np.array([h for h, _ in known])), len(known)]
    out = []
    for n, (a, b) in enumerate(zip(edges, edges[1:])):
        begin = 0 if n == 0 else shown[a]
        end = shown[b] if b < len(known) else len(avi.frames)
        out.append((n, begin * avi.microseconds / 1000, end * avi.microseconds / 1000, end - begin, round(sum(x for _, x in known[a:b]) / (b - a), 6)))
    return out


def clip_rows(files: DataFrame, key: str = "media_id", column: str = "media") -> DataFrame:
    """(media_id, clip, start_ms, end_ms, frames, luma) of every shot of every file.

    Null, empty and other files, and files of which no frame can be decoded, have no row; damaged frames, and those that
    claim more than ``PIXELS``, are skipped, their time belongs to the shot around them.  No file makes a task fail, and
    the time is in proportion to its bytes.  Repeated rows are reported again.  Extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *c) for i, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for c in clips(m)]
            kinds = (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["media_id", "clip", "start_ms", "end_ms", "frames", "luma"])

    rows = files.select(F.col(key).cast("bigint").alias("media_id"), F.col(column).alias("media"))
    return rows.mapInArrow(run, "media_id bigint, clip int, start_ms double, end_ms double, frames int, luma double")


# ---- the media column of the test tables -----------------------------------------------------------------


SIZES = [(16, 16), (16, 16), (12, 20), (9, 23)]  # height and width of films


def film(embedding: list[float], seed: int) -> tuple[bytes, list[int]]:
    """An AVI drawn from a vector, and the lengths of its shots: each shot has colours of its own, with flicker.
    Sizes that aren't whole MCUs, restart markers, Huffman tables and each kind of index occur."""
    v = [float(x or 0) for x in embedding or [0.0]]
    shots, (height, width) = 2 + seed % 3, SIZES[seed % 4]
    frames, lengths = [], []
    ramp = np.linspace(-12, 12, width)
    for s in range(shots):
        x, y = np.nan_to_num([v[(3 * s) % len(v)], v[(3 * s + 1) % len(v)]])
        base = (40 + 150 * (s % 2) + 20 * np.tanh(x), 90 + 70 * ((s // 2) % 2) + 15 * np.tanh(y), 100 + 60 * (s % 2))
        n = 4 + (seed // 3 + s) % 3
        lengths.append(n)
        for k in range(n):
            image = np.empty((height, width, 3))
            image[:] = base
            image[:, :, 0] += ramp[None, :] + 2 * (k % 2)
            frames.append(encode_jpeg(np.clip(image, 0, 255).astype(np.uint8), tables=seed % 5 == 0, restart=seed % 2))
    return write_avi(frames, 40000, width, height, ("idx1", "indx", "none")[seed % 7 % 3]), lengths


def films(embeddings: DataFrame) -> DataFrame:
    """(media_id, media): a small AVI for each row of ``embeddings``, as the test tables have no media of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            media = [film(e, i or 0)[0] for i, e in zip(ids, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(media, pa.binary())], names=["media_id", "media"])

    return embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").mapInArrow(run, "media_id bigint, media binary")
