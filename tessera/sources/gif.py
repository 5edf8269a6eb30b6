"""GIF bytes to pixels and back: the first picture of a file, by the LZW code of its places in a palette."""

from __future__ import annotations

import struct

import numpy as np

#: Levels of red, green and blue for pictures of more than 256 colours.
LEVELS = (6, 7, 6)


def _unpacked(data: bytes, width: int, most: int) -> bytes:
    """Places in the palette of LZW codes that begin with ``width`` bits a place; ``most`` places at most."""
    clear = 1 << width
    fresh = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, out, at, size, last = list(fresh), bytearray(), 0, width + 1, b""
    held = have = 0
    while len(out) < most:
        while have < size:
            if at == len(data):
                raise ValueError("codes end too soon")
            held |= data[at] << have
            have, at = have + 8, at + 1
        code = held & ((1 << size) - 1)
        held, have = held >> size, have - size
        if code == clear:
            table, size, last = list(fresh), width + 1, b""
            continue
        if code == clear + 1:
            break
        if code > len(table) or code == len(table) and not last:
            raise ValueError("no such code")
        piece = table[code] if code < len(table) else last + last[:1]
        out += piece
        if last and len(table) < 4096:
            table.append(last + piece[:1])
            if len(table) == 1 << size and size < 12:
                size += 1
        last = piece
    return bytes(out[:most])


def _packed(places: bytes, width: int) -> bytes:
    clear = 1 << width
    out, held, have = bytearray(), 0, 0

    def put(code: int, size: int) -> None:
        nonlocal held, have
        held |= code << have
        have += size
        while have > 7:
            out.append(held & 255)
            held, have = held >> 8, have - 8

    table: dict[tuple[int, int], int] = {}
    size, following, last = width + 1, clear + 2, None
    put(clear, size)
    for p in places:
        if last is None:
            last = p
        elif (last, p) in table:
            last = table[last, p]
        else:
            put(last, size)
            if following < 4096:
                table[last, p] = following
                if following == 1 << size:
                    size += 1
                following += 1
            else:
                put(clear, size)
                table, size, following = {}, width + 1, clear + 2
            last = p
    put(last, size)
    if following == 1 << size and size < 12:  # the reader has one entry more by now
        size += 1
    put(clear + 1, size)
    put(0, -have % 8)
    return bytes(out)


def gif(rgb: np.ndarray) -> bytes:
    """(H, W, 3 or 4) bytes as a GIF file; alpha is left out. Up to 256 colours are kept as they are; of more, each
    channel goes to the nearest of its LEVELS."""
    h, w = rgb.shape[:2]
    colours, places = np.unique(rgb[:, :, :3].reshape(-1, 3), axis=0, return_inverse=True)
    if len(colours) > 256:
        steps = np.array(LEVELS) - 1
        near = np.round(rgb[:, :, :3].reshape(-1, 3) / 255 * steps) / steps * 255
        colours, places = np.unique(np.round(near).astype(np.uint8), axis=0, return_inverse=True)
    width = max(2, (len(colours) - 1).bit_length())
    palette = np.zeros((1 << width, 3), np.uint8)
    palette[: len(colours)] = colours
    codes = _packed(places.ravel().astype(np.uint8).tobytes(), width)
    blocks = b"".join(bytes([len(codes[i : i + 255])]) + codes[i : i + 255] for i in range(0, len(codes), 255))
    head = b"GIF89a" + struct.pack("<HHBBB", w, h, 0xF0 | (width - 1), 0, 0) + palette.tobytes()
    return head + b"," + struct.pack("<HHHHB", 0, 0, w, h, 0) + bytes([width]) + blocks + b"\0;"


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    """The bytes of the blocks from here on, and where they end."""
    out = bytearray()
    while n := data[at]:
        out += data[at + 1 : at + 1 + n]
        at += 1 + n
    return bytes(out), at + 1


def ungif(data: bytes) -> np.ndarray:
    """(H, W, 3) bytes of a GIF file's first picture on its screen, or (H, W, 4) where some pixels are transparent or
    the picture doesn't cover the screen."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF file")
    w, h, flags = struct.unpack("<HHB", data[6:11])
    if not w or not h:
        raise ValueError("a GIF file without a screen")
    table = lambda at, flags: (np.frombuffer(data, np.uint8, 3 << ((flags & 7) + 1), at).reshape(-1, 3), at + (3 << ((flags & 7) + 1)))
    palette, at = table(13, flags) if flags & 128 else (None, 13)
    clear = None
    while data[at] != 0x3B:
        if data[at] == 0x21:
            kind, (body, end) = data[at + 1], _blocks(data, at + 2)
            if kind == 0xF9 and body[0] & 1:
                clear = body[3]
            at = end
            continue
        if data[at] != 0x2C:
            raise ValueError("no such block")
        x, y, pw, ph, flags = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        palette, at = table(at + 10, flags) if flags & 128 else (palette, at + 10)
        if palette is None:
            raise ValueError("a GIF picture without colours")
        codes, _ = _blocks(data, at + 1)
        places = np.frombuffer(_unpacked(codes, data[at], pw * ph), np.uint8).reshape(ph, pw)
        if flags & 64:  # every 8th line, those between them, every 4th, every 2nd
            lines = np.concatenate([np.arange(a, ph, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
            places = places[np.argsort(lines)]
        out = np.zeros((h, w, 4), np.uint8)
        seen = out[y : y + ph, x : x + pw]
        places = places[: seen.shape[0], : seen.shape[1]]
        seen[:, :, :3] = palette[places]
        seen[:, :, 3] = 255 if clear is None else np.where(places == clear, 0, 255)
        return out if (out[:, :, 3] == 0).any() else out[:, :, :3]
    raise ValueError("a GIF file without a picture")
