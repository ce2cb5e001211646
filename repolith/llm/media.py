"""Media columns: AVI with motion JPEG.

An AVI is read by its RIFF chunks and its index (idx1), its frames are decoded
as baseline JPEG intra frames, and shots are found where the difference of two
neighbouring frames' histograms exceeds a threshold that adapts to the
differences around it. The result is a row for each clip, with times.

decode_jpeg() reads baseline greyscale and YCbCr frames of any Huffman tables;
frames without tables, as most cameras write them, take the standard's.
Where all codes of a frame with their extra bits are equally long and blocks
hold a DC coefficient only, as in the frames encode_samples() writes, decoding
needs no loop: bits are cut and looked up by numpy.

encode_samples() stores bytes as 8-bit samples without loss: each byte is the
grey value of one 8x8 block, whose DC coefficient at a quantiser step of 8 is
the value less 128 exactly. Any JPEG decoder gives the samples back.

Null and empty media have no frames and give no clips; truncated or damaged media
raise ValueError, or give no clips where the caller asks for that (clips()).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

WIDE, HIGH, UNIT, FPS = 64, 64, 64, 25

# --- RIFF ---------------------------------------------------------------------


def chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def write_avi(frames: list[bytes], width: int, height: int, fps: int = FPS, info: dict[bytes, bytes] | None = None) -> bytes:
    most = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width & 0xFFFF, height & 0xFFFF)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    notes = chunk(b"LIST", b"INFO" + b"".join(chunk(k, v) for k, v in info.items())) if info else b""
    parts, index, at = [], [], 4
    for f in frames:
        c = chunk(b"00dc", f)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        parts.append(c)
        at += len(c)
    return chunk(b"RIFF", b"AVI " + head + notes + chunk(b"LIST", b"movi" + b"".join(parts)) + chunk(b"idx1", b"".join(index)))


def chunks(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Name, start and length of each chunk."""
    while start + 8 <= end:
        name, n = data[start : start + 4], struct.unpack_from("<I", data, start + 4)[0]
        if start + 8 + n > end:
            raise ValueError(f"chunk {name!r} runs past its end")
        yield name, start + 8, n
        start += 8 + n + (n & 1)


def in_movi(data: bytes, start: int, end: int, ids: tuple[bytes, ...]) -> Iterator[bytes]:
    """The stream's chunks of a movi list, those in rec lists too."""
    for name, at, n in chunks(data, start, end):
        if name in ids:
            yield data[at : at + n]
        elif name == b"LIST" and data[at : at + 4] == b"rec ":
            yield from in_movi(data, at + 4, at + n, ids)


def read_avi(data: bytes) -> dict:
    """frames of the first video stream (in the index's order, or the movi list's where there is no index; then those of the AVIX
    parts that follow a large file's first), fps, width, height, info. An empty frame stands for the one before it."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI")
    out: dict = {"frames": [], "fps": float(FPS), "width": 0, "height": 0, "info": {}}
    movi = index = stream = None
    first = min(len(data), 8 + struct.unpack_from("<I", data, 4)[0])
    for name, at, n in chunks(data, 12, first):
        kind = data[at : at + 4] if name == b"LIST" else b""
        if name == b"idx1":
            index = (at, n)
        elif kind == b"movi":
            movi = (at, n)
        elif kind == b"INFO":
            out["info"] = {k: data[a : a + m] for k, a, m in chunks(data, at + 4, at + n)}
        elif kind == b"hdrl":
            streams = 0
            for sub, a, m in chunks(data, at + 4, at + n):
                if sub == b"avih" and m >= 40:
                    per, = struct.unpack_from("<I", data, a)
                    out["width"], out["height"] = struct.unpack_from("<II", data, a + 32)
                    out["fps"] = 1e6 / per if per else out["fps"]
                elif sub == b"LIST" and data[a : a + 4] == b"strl":
                    for s, b, k in chunks(data, a + 4, a + m):
                        if s == b"strh" and k >= 28 and data[b : b + 4] == b"vids" and stream is None:
                            stream = streams
                            scale, rate = struct.unpack_from("<II", data, b + 20)
                            out["fps"] = rate / scale if scale and rate else out["fps"]
                    streams += 1
    ids = tuple(b"%02d%s" % (stream or 0, kind) for kind in (b"dc", b"db"))
    if movi and index:
        entries = np.frombuffer(data, np.dtype([("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("n", "<u4")]), index[1] // 16, index[0])
        entries = entries[np.isin(entries["id"], ids)]
        if len(entries):
            # Offsets count from the movi list's name, or in some files from the file's start.
            base = movi[0] if entries["at"][0] < movi[0] else 0
            for a, n in zip(entries["at"].tolist(), entries["n"].tolist(), strict=True):
                if base + a + 8 + n > len(data):
                    raise ValueError("the index points past the end")
                out["frames"].append(data[base + a + 8 : base + a + 8 + n])
    elif movi:
        out["frames"] = list(in_movi(data, movi[0] + 4, movi[0] + movi[1], ids))
    for name, at, n in chunks(data, first + (first & 1), len(data)):
        if name == b"RIFF" and data[at : at + 4] == b"AVIX":
            for sub, a, m in chunks(data, at + 4, at + n):
                if sub == b"LIST" and data[a : a + 4] == b"movi":
                    out["frames"] += in_movi(data, a + 4, a + m, ids)
    return out


# --- JPEG ---------------------------------------------------------------------


def huffman(counts: list[int], symbols: bytes) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol."""
    table, code, k = {}, 0, 0
    for n, m in enumerate(counts, 1):
        for _ in range(m):
            table[n, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return table


# The tables of the JPEG standard (Annex K.3), which frames without tables of their own use. Counts by code length, then symbols.
USUAL = {
    0x00: ([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], bytes(range(12))),
    0x01: ([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0], bytes(range(12))),
    0x10: (
        [0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125],
        bytes.fromhex(
            "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a"
            "535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6"
            "c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
        ),
    ),
    0x11: (
        [0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119],
        bytes.fromhex(
            "0001020311040521310612415107617113223281081442" "91a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a"
            "535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5"
            "c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa"
        ),
    ),
}

#: Category s of a DC difference has a code of 9 - s bits (0: of 9) and s extra bits: any difference of two bytes takes 9 bits.
#: The end of the block takes 1 more.
DC_COUNTS, DC_SYMBOLS = [1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], bytes([8, 7, 6, 5, 4, 3, 2, 1, 0])
AC_COUNTS, AC_SYMBOLS = [1] + [0] * 15, b"\0"


def _codes() -> tuple[np.ndarray, np.ndarray]:
    of, back = np.zeros(511, np.uint64), np.zeros(1024, np.int16)
    by_symbol = {s: (n, c) for (n, c), s in huffman(DC_COUNTS, DC_SYMBOLS).items()}
    for d in range(-255, 256):
        s = abs(d).bit_length()
        _, c = by_symbol[s]
        of[d + 255] = ((c << s) | (d if d >= 0 else d + (1 << s) - 1)) << 1
        back[int(of[d + 255])] = d
    return of, back


CODE_OF, DIFF_OF = _codes()


def segment(mark: int, data: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, mark, len(data) + 2) + data


def jpeg_head(wide: int, high: int) -> bytes:
    return (
        b"\xff\xd8" + segment(0xDB, b"\0" + b"\x08" * 64) + segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * high, 8 * wide, 1, 1, 0x11, 0))
        + segment(0xC4, b"\x00" + bytes(DC_COUNTS) + DC_SYMBOLS) + segment(0xC4, b"\x10" + bytes(AC_COUNTS) + AC_SYMBOLS) + segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    )


def rows_per_frame(n: int) -> int:
    """Rows of blocks of n bytes, dealt evenly over as few frames as hold them."""
    rows = max(1, -(-n // WIDE))
    return -(-rows // -(-rows // HIGH))


def encode_samples(payload: bytes) -> list[bytes]:
    """Frames of WIDE x HIGH blocks at most; the last is filled up with zeros."""
    high = rows_per_frame(len(payload))
    padded = np.frombuffer(payload + b"\0" * (-len(payload) % (WIDE * high)), np.uint8).reshape(-1, WIDE * high).astype(np.int16)
    diff = np.diff(padded, axis=1, prepend=np.int16(128))
    code = CODE_OF[diff + 255].reshape(len(padded), -1, 4)  # four samples are five bytes
    word = (code[..., 0] << np.uint64(30)) | (code[..., 1] << np.uint64(20)) | (code[..., 2] << np.uint64(10)) | code[..., 3]
    bits = word.astype(">u8").view(np.uint8).reshape(len(padded), -1, 8)[..., 3:].reshape(len(padded), -1)
    head = jpeg_head(WIDE, high)
    return [head + b.tobytes().replace(b"\xff", b"\xff\0") + b"\xff\xd9" for b in bits]


ZIGZAG = np.array(sorted(range(64), key=lambda i: (s := i // 8 + i % 8, i % 8 if s % 2 == 0 else i // 8)))
_k = np.arange(8)
COSINES = np.cos((2 * _k[:, None] + 1) * _k[None] * np.pi / 16) * np.where(_k == 0, np.sqrt(0.125), 0.5)


class Frame:
    """A JPEG's segments."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        self.quant: dict[int, np.ndarray] = {}
        self.tables: dict[int, dict] = {}
        self.plain: dict[int, tuple] = {}
        self.restart, self.parts, at = 0, [], 2
        while at + 4 <= len(data):
            mark, n = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + n]
            if mark == 0xDB:
                while body:
                    size = 128 if body[0] >> 4 else 64
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + size], ">u2" if size == 128 else np.uint8).astype(np.int64)
                    body = body[1 + size :]
            elif mark == 0xC4:
                while body:
                    counts = list(body[1:17])
                    k = sum(counts)
                    self.plain[body[0]] = (counts, body[17 : 17 + k])
                    body = body[17 + k :] if k else b""
            elif mark in (0xC0, 0xC1):
                _, self.height, self.width, m = struct.unpack_from(">BHHB", body)
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(m)]
            elif 0xC2 <= mark <= 0xCF:
                raise ValueError("only baseline frames are decoded")
            elif mark == 0xDD:
                self.restart = struct.unpack(">H", body[:2])[0]
            elif mark == 0xDA:
                self.scan = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
                end = data.rfind(b"\xff\xd9")
                self.coded = data[at + 2 + n : end if end > at else len(data)]
                return
            at += 2 + n
        raise ValueError("no scan")

    def fixed(self) -> bool:
        """Whether this is a frame of the kind that encode_samples() writes."""
        return len(self.parts) == 1 and self.plain.get(0) == (DC_COUNTS, DC_SYMBOLS) and self.plain.get(16) == (AC_COUNTS, AC_SYMBOLS) and not self.restart and self.width % 8 == self.height % 8 == 0

    def samples(self) -> np.ndarray:
        """Of a frame of DC blocks of fixed length: each block's grey value."""
        raw = np.frombuffer(self.coded.replace(b"\xff\0", b"\xff"), np.uint8)
        n = self.width // 8 * (self.height // 8)
        if len(raw) * 8 < n * 10:
            raise ValueError("the scan is too short")
        wide = np.zeros((-(-n // 4), 8), np.uint8)
        flat = np.zeros(len(wide) * 5, np.uint8)
        flat[: min(len(raw), len(flat))] = raw[: len(flat)]
        wide[:, 3:] = flat.reshape(-1, 5)
        word = wide.view(">u8").astype(np.uint64).reshape(-1)
        code = np.stack([word >> np.uint64(30), word >> np.uint64(20), word >> np.uint64(10), word], 1).reshape(-1)[:n] & np.uint64(1023)
        step = int(self.quant[self.parts[0][3]][0])
        return np.clip(np.cumsum(DIFF_OF[code].astype(np.int64)) * step // 8 + 128, 0, 255).astype(np.uint8).reshape(self.height // 8, -1)

    def luma(self) -> np.ndarray:
        """The first component's pixels, by the general decoder."""
        if not self.tables:
            self.tables = {k: huffman(*v) for k, v in (USUAL | self.plain).items()}
        pieces = [self.coded]
        if self.restart:  # restart marks cut the scan
            pieces, at = [], 0
            for i in range(len(self.coded) - 1):
                if self.coded[i] == 0xFF and 0xD0 <= self.coded[i + 1] <= 0xD7:
                    pieces.append(self.coded[at:i])
                    at = i + 2
            pieces.append(self.coded[at:])
        most_h, most_v = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        if len(self.parts) == 1:
            most_h = most_v = 1
        across, down = -(-self.width // (8 * most_h)), -(-self.height // (8 * most_v))
        first = self.parts[0]
        h0, v0 = (1, 1) if len(self.parts) == 1 else first[1:3]
        plane = np.zeros((down * v0 * 8, across * h0 * 8))
        mcu, total = 0, across * down
        for piece in pieces:
            bits = Bits(piece.replace(b"\xff\0", b"\xff"))
            before = dict.fromkeys((p[0] for p in self.parts), 0)
            for _ in range(min(self.restart or total, total - mcu)):
                for name, h, v, q in self.parts:
                    dc, ac = self.scan[name]
                    for y in range(1 if len(self.parts) == 1 else v):
                        for x in range(1 if len(self.parts) == 1 else h):
                            block = self.block(bits, self.tables[dc], self.tables[16 + ac], before[name])
                            before[name] = int(block[0])
                            if name == first[0]:
                                c = np.zeros(64)
                                c[ZIGZAG] = block * self.quant[q]
                                top, left = (mcu // across * v0 + y) * 8, (mcu % across * h0 + x) * 8
                                plane[top : top + 8, left : left + 8] = COSINES @ c.reshape(8, 8) @ COSINES.T
                mcu += 1
        return np.clip(np.rint(plane) + 128, 0, 255).astype(np.uint8)[: self.height, : self.width]

    @staticmethod
    def block(bits: Bits, dc: dict, ac: dict, before: int) -> np.ndarray:
        out = np.zeros(64, np.int64)
        out[0] = before + bits.value(bits.symbol(dc))
        k = 1
        while k < 64:
            s = bits.symbol(ac)
            if s == 0:
                break
            k += s >> 4
            if s & 15:
                if k > 63:
                    raise ValueError("too many coefficients")
                out[k] = bits.value(s & 15)
            k += 1
        return out


class Bits:
    def __init__(self, data: bytes):
        self.data, self.at = np.unpackbits(np.frombuffer(data, np.uint8)).tolist(), 0

    def take(self, n: int) -> int:
        if self.at + n > len(self.data):
            raise ValueError("the scan is too short")
        v = 0
        for b in self.data[self.at : self.at + n]:
            v = 2 * v + b
        self.at += n
        return v

    def symbol(self, table: dict) -> int:
        code = 0
        for n in range(1, 17):
            code = 2 * code + self.take(1)
            if (n, code) in table:
                return table[n, code]
        raise ValueError("no such code")

    def value(self, n: int) -> int:
        v = self.take(n) if n else 0
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


def decode_jpeg(data: bytes) -> np.ndarray:
    """The luma plane."""
    f = Frame(data)
    return np.repeat(np.repeat(f.samples(), 8, 0), 8, 1) if f.fixed() else f.luma()


# --- shots --------------------------------------------------------------------


def histogram(plane: np.ndarray, bins: int = 32) -> np.ndarray:
    return np.bincount(plane.reshape(-1) >> (8 - bins.bit_length() + 1), minlength=bins) / max(1, plane.size)


def shots(histograms: list[np.ndarray], window: int = 8, times: float = 6.0, floor: float = 0.2) -> list[tuple[int, int]]:
    """(first, last) frames. A cut is where the difference is over the floor and over the median of the differences around it by so
    many median deviations, which other cuts nearby hardly move."""
    if not histograms:
        return []
    d = np.array([np.abs(a - b).sum() / 2 for a, b in zip(histograms, histograms[1:], strict=False)])
    starts = [0]
    for i, x in enumerate(d):
        near = np.concatenate([d[max(0, i - window) : i], d[i + 1 : i + 1 + window]])
        usual = np.median(near) if len(near) else 0.0
        if x > floor and x > usual + times * (np.median(np.abs(near - usual)) if len(near) else 0.0):
            starts.append(i + 1)
    return [(a, b - 1) for a, b in zip(starts, [*starts[1:], len(histograms)], strict=True)]


def clip_rows(data: bytes) -> list[tuple[int, int, int, float, float]]:
    """clip, first and last frame, start and end in seconds. Empty frames repeat the one before them, the first ones the first that isn't empty. Whatever is wrong with the data, the error is a ValueError."""
    try:
        avi = read_avi(data)
        seen = [histogram(decode_jpeg(f)) if f else None for f in avi["frames"]]
    except (LookupError, struct.error, OverflowError) as e:
        raise ValueError(f"damaged media: {e!r}") from e
    last = next((h for h in seen if h is not None), None)
    if last is None:
        return []
    filled = []
    for h in seen:
        last = last if h is None else h
        filled.append(last)
    return [(k, a, b, a / avi["fps"], (b + 1) / avi["fps"]) for k, (a, b) in enumerate(shots(filled))]


def clips(media: DataFrame, id_column: str = "media_id", column: str = "media", damaged: str = "raise") -> DataFrame:
    """A row for each clip of each media value. damaged: raise, or skip media that can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    rows += [(key, *r) for r in clip_rows(data.as_py())] if data.as_py() else []
                except ValueError:
                    if damaged != "skip":
                        raise
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
            names = [id_column, "clip", "first_frame", "last_frame", "start_s", "end_s"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return media.select(id_column, column).mapInArrow(run, f"{id_column} long, clip int, first_frame int, last_frame int, start_s double, end_s double")


# --- texts as media -------------------------------------------------------------


def store(text: str | None) -> tuple[bytes, int]:
    """A text's AVI and its length in bytes. The payload is the text with zeros behind it up to a positive multiple of UNIT; its size stands in the AVI's notes."""
    data = (text or "").encode("utf-8", "surrogatepass")
    size = max(UNIT, -(-len(data) // UNIT) * UNIT)
    frames = encode_samples(data + b"\0" * (size - len(data)))
    return write_avi(frames, 8 * WIDE, 8 * rows_per_frame(size), info={b"ICMT": b"%d" % size}), len(data)


def load(media: bytes) -> tuple[bytes, list[np.ndarray], float]:
    """The payload, each frame's samples, and frames a second."""
    avi = read_avi(media)
    frames = [Frame(f).samples() for f in avi["frames"]]
    return b"".join(f.tobytes() for f in frames)[: int(avi["info"][b"ICMT"])], frames, avi["fps"]


def text_media(documents: DataFrame) -> DataFrame:
    """Every text stored as an AVI, read back, with digests and features. A null text counts as empty."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def one(text: str | None) -> tuple:
        media, n = store(text)
        payload, frames, fps = load(media)
        cut = shots([histogram(f) for f in frames])
        mean = np.frombuffer(payload, np.uint8).mean()
        feature = f"frames={len(frames)};mean={mean:.3f};clips=" + ",".join(f"{a / fps:.2f}-{(b + 1) / fps:.2f}" for a, b in cut)
        return n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(t.as_py()) for t in batch.column(1)]
            cols = [batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds[1:], strict=True))] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return documents.select("doc_id", "text").mapInArrow(run, schema)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))
