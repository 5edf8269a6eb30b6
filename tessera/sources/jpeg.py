"""JPEG bytes to pixels and back: baseline and progressive files are read, baseline files are written.

The cosine transforms, colours and sample grids of a whole picture are numpy; only the bits of the entropy code, each of
which depends on those before it, are read one symbol at a time, by tables of 16 bits.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np

from tessera.functions.kernels import bilinear

#: Places of a block's coefficients, row by row, in the order of the file: diagonals, downwards and upwards in turn.
ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8) * (1 if (i // 8 + i % 8) % 2 else -1)))
#: The standard's example quantisers, of brightness and of colour, row by row.
BRIGHTNESS = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
COLOUR = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
)
_k = np.arange(8)
#: Row u is the u-th cosine of a block's line.
COSINES = np.cos((2 * _k[None, :] + 1) * _k[:, None] * np.pi / 16) * np.where(_k[:, None] == 0, np.sqrt(1 / 8), 0.5)
#: Brightness and two colours of red, green and blue.
YCC = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])
RGB = np.linalg.inv(YCC)

#: How far a channel of a pixel may come back at quality 100.
AWAY = 3


class _Component:
    """One of a picture's colours: its sampling, its quantiser, and the coefficients of all its blocks."""

    def __init__(self, sampling: int, table: int) -> None:
        self.h, self.v, self.table = sampling >> 4, sampling & 15, table

    def lay_out(self, width: int, height: int, most_h: int, most_v: int) -> None:
        self.wide, self.high = -(-width * self.h // most_h), -(-height * self.v // most_v)
        self.across, self.down = -(-self.wide // 8), -(-self.high // 8)
        self.to = most_h / self.h, most_v / self.v
        self.stride, lines = -(-width // (8 * most_h)) * self.h, -(-height // (8 * most_v)) * self.v
        self.blocks = [0] * (64 * self.stride * lines)

    def plane(self, quantiser: np.ndarray) -> np.ndarray:
        """The samples of all blocks side by side."""
        x = np.zeros((len(self.blocks) // 64, 64))
        x[:, ZIGZAG] = np.array(self.blocks).reshape(-1, 64) * quantiser
        x = np.clip(np.round(COSINES.T @ x.reshape(-1, 8, 8) @ COSINES + 128), 0, 255)
        return x.reshape(-1, self.stride, 8, 8).swapaxes(1, 2).reshape(-1, 8 * self.stride)

    def stretched(self, quantiser: np.ndarray, width: int, height: int) -> np.ndarray:
        """A sample for every pixel; where there are fewer, those between the two nearest in proportion."""
        p = self.plane(quantiser)[: self.high, : self.wide]
        if self.to != (1, 1):
            p = bilinear(p, round(self.high * self.to[1]), round(self.wide * self.to[0]), "replicate")
        return p[:height, :width].astype(np.float64)


def _lookup(counts: bytes, symbols: bytes) -> list[int]:
    """For every 16 bits: 256 times the length of the code that they begin with, plus its symbol."""
    table, at = [], 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[at : at + n]:
            table += [length << 8 | symbol] * (1 << (16 - length))
        at += n
    return table + [0] * ((1 << 16) - len(table))


class _Scan:
    """The blocks of one pass over a picture. Coefficients first..last are read, from bit ``low`` on; ``high`` is the bit
    that an earlier pass ended with, 0 if there was none."""

    def __init__(self, parts: list[tuple[_Component, list[int], list[int]]], first: int, last: int, high: int, low: int, progressive: bool) -> None:
        self.parts, self.first, self.last, self.high, self.low, self.progressive = parts, first, last, high, low, progressive

    def order(self) -> Iterator[tuple[int, int, int]]:
        """(number of the group of blocks, part, first coefficient) of every block: a part alone goes by its own lines."""
        if len(self.parts) == 1:
            c = self.parts[0][0]
            for y in range(c.down):
                for x in range(c.across):
                    yield y * c.across + x, 0, 64 * (y * c.stride + x)
            return
        c = self.parts[0][0]
        wide, high = c.stride // c.h, len(c.blocks) // 64 // c.stride // c.v
        for group in range(wide * high):
            for i, (c, _, _) in enumerate(self.parts):
                for k in range(c.h * c.v):
                    yield group, i, 64 * ((group // wide * c.v + k // c.h) * c.stride + group % wide * c.h + k % c.h)

    def read(self, intervals: list[bytes], restart: int) -> None:
        wait, number, bits, skip = -1, -1, None, 0
        before = [0] * len(self.parts)
        for group, i, at in self.order():
            if restart and group // restart != wait or bits is None:
                wait, number, before, skip = group // restart if restart else 0, number + 1, [0] * len(self.parts), 0
                bits = _Bits(intervals[number])
            c, dc, ac = self.parts[i]
            b = c.blocks
            if self.first == 0:
                if self.high:
                    b[at] |= bits.take(1) << self.low
                else:
                    before[i] += bits.signed(bits.symbol(dc))
                    b[at] = before[i] << self.low if before[i] >= 0 else -(-before[i] << self.low)
            if self.last and not (self.progressive and self.first == 0):
                skip = (self.refined if self.high else self.fresh)(bits, b, at, ac, skip)

    def fresh(self, bits: _Bits, b: list[int], at: int, ac: list[int], skip: int) -> int:
        """New coefficients of a block; what is returned is the number of blocks after it that have none."""
        if skip:
            return skip - 1
        k, last, low = max(1, self.first), self.last, self.low
        while k <= last:
            rs = bits.symbol(ac)
            run, size = rs >> 4, rs & 15
            if size:
                k += run
                v = bits.signed(size)
                b[at + k] = v << low if v >= 0 else -(-v << low)
                k += 1
            elif run == 15:
                k += 16
            else:
                return (1 << run) - 1 + bits.take(run)
        return 0

    def refined(self, bits: _Bits, b: list[int], at: int, ac: list[int], skip: int) -> int:
        """One more bit of the coefficients that aren't zero, and those that begin with this bit."""
        k, last, one = self.first, self.last, 1 << self.low

        def refine(place: int) -> None:
            if bits.take(1) and not abs(b[place]) & one:
                b[place] += one if b[place] > 0 else -one

        if not skip:
            while k <= last:
                rs = bits.symbol(ac)
                run, value = rs >> 4, 0
                if rs & 15:
                    value = one if bits.take(1) else -one
                elif run < 15:
                    skip = (1 << run) + bits.take(run)
                    break
                while k <= last:
                    if b[at + k]:
                        refine(at + k)
                    elif run:
                        run -= 1
                    else:
                        b[at + k] = value
                        k += 1
                        break
                    k += 1
        if skip:
            for place in range(at + k, at + last + 1):
                if b[place]:
                    refine(place)
            return skip - 1
        return 0


class _Bits:
    """Bits of one interval, read through windows of 24 that begin at every byte."""

    def __init__(self, data: bytes) -> None:
        a = np.frombuffer(data.replace(b"\xff\x00", b"\xff") + bytes(64), np.uint8).astype(np.int64)
        self.windows, self.at = (a[:-2] << 16 | a[1:-1] << 8 | a[2:]).tolist(), 0

    def symbol(self, table: list[int]) -> int:
        found = table[self.windows[self.at >> 3] >> (8 - (self.at & 7)) & 0xFFFF]
        if not found:
            raise ValueError("no such code")
        self.at += found >> 8
        return found & 255

    def take(self, n: int) -> int:
        if not n:
            return 0
        value = (self.windows[self.at >> 3] >> (8 - (self.at & 7)) & 0xFFFF) >> (16 - n)
        self.at += n
        return value

    def signed(self, n: int) -> int:
        value = self.take(n)
        return value if not n or value >> (n - 1) else value - (1 << n) + 1


def unjpeg(data: bytes) -> np.ndarray:
    """(H, W, 1 or 3) bytes of a JPEG file of 8 bits a sample; a colour of fewer samples is stretched."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    quantisers: dict[int, np.ndarray] = {}
    tables: dict[int, list[int]] = {}
    parts: dict[int, _Component] = {}
    at, restart, adobe, width, height, progressive = 2, 0, None, 0, 0, False
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        if kind == 0xD9:
            break
        n = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if kind == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                quantisers[body[0] & 15] = np.frombuffer(body, ">u2" if wide == 2 else "u1", 64, 1).astype(np.int64)
                body = body[1 + 64 * wide :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = _lookup(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind in (0xC0, 0xC1, 0xC2):
            progressive = kind == 0xC2
            depth, height, width, n = struct.unpack(">BHHB", body[:6])
            if depth != 8 or n not in (1, 3) or height < 1 or width < 1:
                raise ValueError("only JPEG files of 8 bits and of one or three colours")
            parts = {body[6 + 3 * i]: _Component(body[7 + 3 * i], body[8 + 3 * i]) for i in range(n)}
            if n == 1:
                parts[body[6]].h = parts[body[6]].v = 1
            for c in parts.values():
                c.lay_out(width, height, max(c.h for c in parts.values()), max(c.v for c in parts.values()))
        elif 0xC3 <= kind <= 0xCF and kind != 0xCC:
            raise ValueError("neither a baseline nor a progressive JPEG file")
        elif kind == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif kind == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif kind == 0xDA:
            end = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.DOTALL).search(data, at)
            end = end.start() if end else len(data)
            own = [(parts[body[1 + 2 * i]], tables.get(body[2 + 2 * i] >> 4, []), tables.get(16 | body[2 + 2 * i] & 15, [])) for i in range(body[0])]
            first, last, bits = body[-3:]
            _Scan(own, first, last if progressive else 63, bits >> 4, bits & 15, progressive).read(re.split(rb"\xff[\xd0-\xd7]", data[at:end]), restart)
            at = end
    if not parts:
        raise ValueError("a JPEG file without a picture")
    out = np.stack([c.stretched(quantisers[c.table], width, height) for c in parts.values()], axis=2)
    if out.shape[2] == 3 and adobe != 0 and bytes(parts) != b"RGB":
        out = (out - [0, 128, 128]) @ RGB.T
    return np.clip(np.round(out), 0, 255).astype(np.uint8)


def quantiser(base: tuple[int, ...], quality: int) -> np.ndarray:
    """A quantiser for a quality of 1 to 100, of which the last has no quantisation but to whole numbers."""
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(base) * scale + 50) // 100, 1, 255).astype(np.int64)


def _codes(symbols: list[int]) -> tuple[bytes, bytes, dict[int, tuple[int, int]]]:
    """Huffman's code of these symbols: counts of each length, symbols by length, and (code, length) of each.

    A symbol counts as a thousandth of all at least, so that no code is longer than 16 bits, and one code, of ones
    alone, belongs to no symbol.
    """
    seen = Counter(symbols or [0])
    least = 1 + len(symbols) // 1000
    heap = [(max(n, least), s, (s,)) for s, n in seen.items()] + [(0, 256, (256,))]
    heapq.heapify(heap)
    depth = Counter()
    while len(heap) > 1:
        (n, _, a), (m, first, b) = heapq.heappop(heap), heapq.heappop(heap)
        depth.update(a + b)
        heapq.heappush(heap, (n + m, first, a + b))
    order = sorted(depth, key=lambda s: (depth[s], s == 256, s))
    code, length, out = 0, depth[order[0]], {}
    for s in order:
        code <<= depth[s] - length
        length = depth[s]
        out[s] = (code, length)
        code += 1
    # The symbol that isn't one is the rarest, so that it is among the longest, and the last of them.
    out.pop(256)
    kept = order[:-1]
    counts = Counter(depth[s] for s in kept)
    return bytes(counts[k] for k in range(1, 17)), bytes(kept), out


def _blocks(plane: np.ndarray) -> np.ndarray:
    """Blocks of 8 x 8 of a plane whose sides are multiples of 8, line by line."""
    return plane.reshape(-1, 8, plane.shape[1] // 8, 8).swapaxes(1, 2).reshape(-1, 8, 8)


def _apart(x: np.ndarray, rgb: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """How far the pixels of each block come back at most; x: whole coefficients (block, colour, 8, 8), rgb: (block, 8, 8,
    channel), seen: which pixels count."""
    samples = np.clip(np.round(COSINES.T @ x @ COSINES + 128), 0, 255).transpose(0, 2, 3, 1) - [0, 128, 128]
    back = np.clip(np.round(samples @ RGB.T), 0, 255)
    return (np.abs(back - rgb).max(axis=3) * seen).max(axis=(1, 2))


def _settled(x: np.ndarray, exact: np.ndarray, rgb: np.ndarray, seen: np.ndarray) -> None:
    """Moves coefficients of blocks that come back more than AWAY away, one at a time by one, the one that lessens the
    large errors most, until none is so far. Rounding each to the nearest has the least error in all, but now and then
    many errors meet in one pixel."""
    for b in np.flatnonzero(_apart(x, rgb, seen) > AWAY):
        # What one more of each coefficient does to every pixel's red, green and blue, and one less.
        one = np.einsum("rc,ui,vj->cuvijr", RGB, COSINES, COSINES).reshape(192, 64, 3)
        moves = np.concatenate([one, -one])
        off = np.einsum("cu,cupr->pr", (x[b] - exact[b]).reshape(3, 64), one.reshape(3, 64, 64, 3))
        counts, far = seen[b].reshape(64, 1), [b]
        cost = ((off * counts) ** 8).sum()
        best, least = x[b].copy(), _apart(x[far], rgb[far], seen[far])[0]
        while least > AWAY:
            costs = (((off + moves) * counts) ** 8).sum(axis=(1, 2))
            m = int(costs.argmin())
            if costs[m] >= cost:
                break
            off, cost = off + moves[m], costs[m]
            x[b].reshape(192)[m % 192] += 1 if m < 192 else -1
            if (now := _apart(x[far], rgb[far], seen[far])[0]) < least:
                best, least = x[b].copy(), now
        x[b] = best


def jpeg(rgb: np.ndarray, quality: int = 90) -> bytes:
    """(H, W, 3 or 4) bytes as a baseline JPEG file with a sample of each colour for every pixel; alpha is left out.

    At quality 100 no channel of a pixel comes back more than 3 away; below, the error is that of the quantisers.
    """
    h, w = rgb.shape[:2]
    whole = np.pad(rgb[:, :, :3], ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge").astype(np.float64)
    ycc = whole @ YCC.T - [128, 0, 0]
    tables = [quantiser(BRIGHTNESS, quality), quantiser(COLOUR, quality)]
    exact = np.stack([COSINES @ _blocks(ycc[:, :, c]) @ COSINES.T for c in range(3)], axis=1)
    # Ten bits is the most that a coefficient has a code for.
    x = np.clip(np.round(exact / np.stack([tables[min(c, 1)].reshape(8, 8) for c in range(3)])), -1023, 1023)
    if quality == 100:
        seen = np.pad(np.ones((h, w)), ((0, -h % 8), (0, -w % 8)))
        _settled(x, exact, np.stack([_blocks(whole[:, :, c]) for c in range(3)], axis=3), _blocks(seen))
    parts = [x[:, c].reshape(-1, 64).astype(np.int64)[:, ZIGZAG] for c in range(3)]
    symbols: list[list[tuple[int, int, int]]] = [[], [], [], []]  # (symbol, bits behind it, how many) by table
    order: list[tuple[int, int]] = []
    before = [0, 0, 0]

    def put(table: int, symbol: int, value: int, size: int) -> None:
        order.append((table, len(symbols[table])))
        symbols[table].append((symbol, value if value >= 0 else value + (1 << size) - 1, size))

    for b in range(len(parts[0])):
        for c in range(3):
            block, two = parts[c][b], 2 * min(c, 1)
            step = int(block[0]) - before[c]
            before[c] = int(block[0])
            put(two, step.bit_length(), step, step.bit_length())
            last = 0
            for k in np.flatnonzero(block[1:]) + 1:
                run, v = int(k) - last - 1, int(block[k])
                while run > 15:
                    put(two + 1, 0xF0, 0, 0)
                    run -= 16
                put(two + 1, run << 4 | v.bit_length(), v, v.bit_length())
                last = int(k)
            if last < 63:
                put(two + 1, 0, 0, 0)
    coded = [_codes([s for s, _, _ in t]) for t in symbols]
    bits = []
    for table, i in order:
        symbol, value, size = symbols[table][i]
        code, length = coded[table][2][symbol]
        bits.append(f"{code:0{length}b}" + (f"{value:0{size}b}" if size else ""))
    line = "".join(bits)
    line += "1" * (-len(line) % 8)
    packed = np.packbits(np.frombuffer(line.encode(), np.uint8) - 48).tobytes().replace(b"\xff", b"\xff\x00")
    chunk = lambda kind, body: bytes([0xFF, kind]) + struct.pack(">H", 2 + len(body)) + body
    out = [b"\xff\xd8", chunk(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0")]
    out += [chunk(0xDB, bytes([i, *t[ZIGZAG].tolist()])) for i, t in enumerate(tables)]
    out.append(chunk(0xC0, struct.pack(">BHHB", 8, h, w, 3) + bytes([1, 17, 0, 2, 17, 1, 3, 17, 1])))
    out += [chunk(0xC4, bytes([(i % 2) << 4 | i // 2]) + counts + kept) for i, (counts, kept, _) in enumerate(coded)]
    return b"".join([*out, chunk(0xDA, bytes([3, 1, 0, 2, 17, 3, 17, 0, 63, 0])), packed, b"\xff\xd9"])
