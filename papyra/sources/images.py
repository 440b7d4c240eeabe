"""Size, format and camera data of images, read from their headers; images within HTML; keys that tell equal images."""

from __future__ import annotations

import base64
import binascii
import re
import struct
from urllib.parse import unquote_to_bytes

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numbers of the camera fields that are read.
EXIF = {
    0x010F: "Make", 0x0110: "Model", 0x0132: "DateTime", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized", 0x0131: "Software", 0x0112: "Orientation", 0x011A: "XResolution", 0x011B: "YResolution", 0x0128: "ResolutionUnit",
    0x829A: "ExposureTime", 0x829D: "FNumber", 0x8827: "ISO", 0x920A: "FocalLength", 0x9209: "Flash", 0xA403: "WhiteBalance",
}
_GPS = {2: "GPSLatitude", 4: "GPSLongitude", 6: "GPSAltitude"}
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def _tiff(data: bytes, base: int = 0) -> tuple[dict[int, str], list[dict[int, list]]]:
    """Camera fields of a TIFF structure, and the tags of each of its frames."""
    order = {b"II": "<", b"MM": ">"}.get(data[base : base + 2])
    if order is None:
        raise ValueError("no TIFF header")
    unpack = lambda f, at: struct.unpack_from(order + f, data, base + at)
    out: dict[int, str] = {}

    def entries(at: int) -> tuple[dict[int, list], int]:
        (n,), found = unpack("H", at), {}
        for i in range(n):
            tag, kind, count = unpack("HHI", at + 2 + 12 * i)
            size = _SIZES.get(kind, 0) * count
            place = at + 2 + 12 * i + 8 if size <= 4 else unpack("I", at + 2 + 12 * i + 8)[0]
            if kind == 2:
                found[tag] = [data[base + place : base + place + count].split(b"\0")[0].decode("latin-1").strip()]
            elif kind in (5, 10):
                pairs = [unpack("II" if kind == 5 else "ii", place + 8 * k) for k in range(min(count, 8))]
                found[tag] = [a / b if b else 0.0 for a, b in pairs]
            elif kind in (3, 4, 9):
                found[tag] = [unpack({3: "H", 4: "I", 9: "i"}[kind], place + _SIZES[kind] * k)[0] for k in range(min(count, 8))]
        return found, unpack("I", at + 2 + 12 * n)[0]

    frames, (at,), seen = [], unpack("I", 4), set()
    while at and at not in seen and base + at + 2 <= len(data):
        seen.add(at)
        found, at = entries(at)
        frames.append(found)
    shown = lambda v: v if isinstance(v, str) else f"{v:g}"
    if frames:
        every = dict(frames[0])
        for pointer, names in ((0x8769, None), (0x8825, _GPS)):
            if pointer in frames[0]:
                more, _ = entries(frames[0][pointer][0])
                every |= {(t if names is None else -t): v for t, v in more.items() if names is None or t in names}
        for tag, values in every.items():
            name = EXIF.get(tag) or _GPS.get(-tag)
            if name and values:
                out[name] = ", ".join(map(shown, values))
    return out, frames


def image_metadata(data: bytes) -> dict:
    """width, height, format, frames and exif of an image; an unknown or cut header is an error."""
    width = height = None
    frames, exif = 1, {}
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        form = "PNG"
        width, height = struct.unpack_from(">II", data, 16)
        at = data.find(b"eXIf")
        if at > 0:
            exif = _tiff(data, at + 4)[0]
    elif data[:3] == b"\xff\xd8\xff":
        form, at = "JPEG", 2
        while at + 9 < len(data):
            if data[at] != 0xFF:
                at += 1
                continue
            mark = data[at + 1]
            if mark in (0xFF, 0x01) or 0xD0 <= mark <= 0xD8:
                at += 1 if mark == 0xFF else 2
                continue
            (size,) = struct.unpack_from(">H", data, at + 2)
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack_from(">HH", data, at + 5)
                break
            if mark == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                try:
                    exif = _tiff(data, at + 10)[0]
                except (ValueError, struct.error):
                    exif = {}
            at += 2 + size
    elif data[:6] in (b"GIF87a", b"GIF89a"):
        form = "GIF"
        width, height = struct.unpack_from("<HH", data, 6)
    elif data[:2] == b"BM":
        form = "BMP"
        width, height = struct.unpack_from("<ii", data, 18)
        height = abs(height)
    elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        form = "WEBP"
        if data[12:16] == b"VP8X":
            width, height = (1 + int.from_bytes(data[a : a + 3], "little") for a in (24, 27))
        elif data[12:16] == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            width, height = 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        else:
            width, height = (x & 0x3FFF for x in struct.unpack_from("<HH", data, 26))
    elif data[:4] in (b"II*\0", b"MM\0*"):
        form = "TIFF"
        exif, all_frames = _tiff(data)
        frames = len(all_frames)
        if all_frames:
            width, height = (all_frames[0].get(t, [None])[0] for t in (256, 257))
    else:
        raise ValueError("the image's format isn't known")
    if width is None or height is None:
        raise ValueError("the image's header is cut off")
    return {"width": width, "height": height, "format": form, "frames": frames, "exif": exif}


def read_image(data: bytes) -> tuple[str, dict, list]:
    """An image without OCR: no text, its metadata."""
    return "", image_metadata(data), []


_IMG = re.compile(r"<img\b[^>]*>", re.I)
_SVG = re.compile(r"<svg\b.*?</svg>", re.I | re.S)
_ATTR = re.compile(r"""([\w-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")


def inline_images(page: str) -> list[tuple[str, str, bytes]]:
    """(format, description, bytes) of the images that an HTML page holds itself: data URIs and SVG elements, in order."""
    found = []
    for m in _IMG.finditer(page):
        a = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(m.group())}
        d = re.match(r"data:image/([\w.+-]+)((?:;[\w=-]+)*),(.*)", a.get("src", ""), re.S | re.I)
        if d:
            try:
                data = base64.b64decode(re.sub(r"\s", "", d.group(3)), validate=True) if ";base64" in d.group(2).lower() else unquote_to_bytes(d.group(3))
            except (binascii.Error, ValueError):
                continue
            found.append((m.start(), d.group(1).lower().removesuffix("+xml"), a.get("alt") or a.get("title") or "", data))
    found += [(m.start(), "svg", "", m.group().encode()) for m in _SVG.finditer(page)]
    return [x[1:] for x in sorted(found)]


#: Images below so many bytes are hashed whole, others by so many at each end.
SMALL, SAMPLE = 1024, 512


def image_hash(data: Column, form: Column) -> Column:
    """Checksum that tells equal images: of all bytes, or of the size, both ends and the format of a larger one."""
    size = F.octet_length(data)
    sample = F.concat(size.cast("string").cast("binary"), F.substring(data, 1, SAMPLE), F.substring(data, size - SAMPLE + 1, F.lit(SAMPLE)), F.coalesce(form, F.lit("")).cast("binary"))
    return F.when(size < SMALL, F.crc32(data)).otherwise(F.crc32(sample))


def ocr_cache_key(data: Column, backend: str, settings: dict) -> Column:
    """Key under which the OCR result of an image is kept: its bytes, the back end and the settings, in order of their names."""
    said = "&".join(f"{k}={settings[k]}" for k in sorted(settings))
    return F.sha2(F.concat_ws("|", F.sha2(data, 256), F.lit(backend), F.lit(said)), 256)
