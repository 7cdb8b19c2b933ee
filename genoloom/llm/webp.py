"""Lossless WebP: many images are decoded, and encoded, at the same time with array operations."""
from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

# Fixed values of the format.
SIGNATURE, CHANNEL, GREEN, LENGTHS, DISTANCES, MAX_BITS = 0x2F, 256, 280, 24, 40, 15
FAST = 9  # bits of a code that are looked up at once; not of the format
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
CHANNELS = ((1, 16), (2, 0), (3, 24))  # codes of red, blue and alpha, and their places in a pixel
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_FACTOR = np.uint32(0x1E35A7BD)
NEAR = (  # (dx, dy) of the distance codes 1 to 120
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
NEAR_DX, NEAR_DY = np.array(NEAR).T
REVERSED = np.array([int(f"{v:015b}"[::-1], 2) for v in range(1 << MAX_BITS)], np.int32)
FAST_ORDER, FAST_MASK = REVERSED[: 1 << FAST] >> (MAX_BITS - FAST), np.uint64((1 << FAST) - 1)


ONE = np.uint64(1)


class WebpError(ValueError):
    pass


def cache_slot(pixels: np.ndarray, shift: np.ndarray | np.uint32) -> np.ndarray:
    """The place in a cache of b bits of each pixel; shift: 32 - b."""
    with np.errstate(over="ignore"):
        return (pixels * CACHE_FACTOR) >> shift


def spread(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


# --- reading -----------------------------------------------------------------------------------

@dataclass
class Codes:
    """Canonical prefix codes, a row each: by length the end of its codes (left-aligned) and where its symbols start.

    ``fast`` has the answer for codes of up to FAST bits by the next FAST bits as they are read, first bit lowest: length and symbol, -1 for longer codes.
    """

    limit: np.ndarray
    base: np.ndarray
    symbols: np.ndarray
    fast: np.ndarray

    @classmethod
    def of(cls, lengths: np.ndarray) -> Codes:
        """From code lengths, a row per code; a row with one symbol takes no bits."""
        n = len(lengths)
        rows, cols = np.nonzero(lengths)
        own = lengths[rows, cols]
        order = np.argsort(rows << 4 | own, kind="stable")
        cols, own = cols[order], own[order]  # by row, length, symbol
        some = np.bincount(rows, minlength=n)
        single, first_of = some == 1, np.cumsum(some) - some
        counts = np.bincount(rows << 4 | own, minlength=n << 4).reshape(n, -1)
        weight = counts << (MAX_BITS - np.arange(MAX_BITS + 1))
        limit = np.cumsum(weight, axis=1)
        if ((limit[:, -1] != 1 << MAX_BITS) & ~single).any():
            raise WebpError("a prefix code is not complete")
        first = (limit - weight) >> (MAX_BITS - np.arange(MAX_BITS + 1))  # first code of each length
        seen = np.cumsum(counts, axis=1) - counts
        base = seen - first + first_of[:, None]
        limit[single], base[single] = 1 << MAX_BITS, first_of[single, None]
        own = np.where(single[rows], 0, own)
        width = np.where(own <= FAST, 1 << np.maximum(FAST - own, 0), 0)
        upto = np.cumsum(width) - width
        start = upto - upto[first_of][rows] + (rows << FAST)
        short = width > 0
        fast = np.full(n << FAST, -1, np.int32)
        fast[np.repeat(start[short], width[short]) + spread(width[short])] = np.repeat(own[short] << 16 | cols[short], width[short])
        return cls(limit[:, :MAX_BITS].astype(np.int32), base, cols.astype(np.int16), fast.reshape(n, -1)[:, FAST_ORDER].ravel())


class Reader:
    """Bit positions in one buffer, one for each stream; every call serves many streams."""

    def __init__(self, streams: list[bytes]):
        sizes = np.array([len(s) for s in streams], np.int64)
        self.raw = b"".join(streams) + bytes(16)
        self.words = np.ndarray(len(self.raw) - 7, "<u8", self.raw, strides=(1,))
        self.at = (np.cumsum(sizes) - sizes) * 8
        self.end = np.cumsum(sizes) * 8

    def peek(self, who: np.ndarray) -> np.ndarray:
        """At least 57 bits."""
        at = np.minimum(self.at[who], self.end[-1] + 64)
        return self.words[at >> 3] >> (at & 7).astype(np.uint64)

    def bits(self, who: np.ndarray, n) -> np.ndarray:
        n = np.asarray(n, np.int64)
        out = self.peek(who) & ((np.uint64(1) << n.astype(np.uint64)) - np.uint64(1))
        self.at[who] += n
        return out.astype(np.int64)

    def check(self, who: np.ndarray) -> None:
        if (self.at[who] > self.end[who]).any():
            raise WebpError("a stream ends too early")


def _found(window: np.ndarray, codes: Codes, base: np.ndarray) -> np.ndarray:
    """Length << 16 | next symbol, from 15 bits at least; ``base``: where the code's part of ``fast`` starts."""
    found = codes.fast[base + (window & FAST_MASK).view(np.int64)]
    if (slow := np.flatnonzero(found < 0)).size:
        row, v = base[slow] >> FAST, REVERSED[(window[slow] & np.uint64(0x7FFF)).view(np.int64)]
        n = (v[:, None] >= codes.limit[row]).sum(axis=1)
        found[slow] = n << 16 | codes.symbols[codes.base[row, n] + (v >> (MAX_BITS - n))]
    return found


def _symbol(window: np.ndarray, codes: Codes, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Next symbol and its length in bits, from 15 bits at least."""
    found = _found(window, codes, rows << FAST).astype(np.int64)
    return found & 0xFFFF, found >> 16


#: What a symbol of a code for code lengths stands for: extra bits, and how many lengths without them.
REPEAT_BITS, REPEATS = np.array([0] * 16 + [2, 3, 7]), np.array([1] * 16 + [3, 3, 11])


def _read_lengths(r: Reader, who: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """Code lengths of one prefix code per stream; sizes: its number of symbols."""
    out = np.zeros((len(who), width), np.int64)
    simple = r.bits(who, 1) == 1
    if simple.any():
        rows, own = np.flatnonzero(simple), who[simple]
        two, wide = r.bits(own, 1), r.bits(own, 1)
        first = r.bits(own, np.where(wide == 1, 8, 1))
        second = r.bits(own, 8 * two)
        if (np.maximum(first, second) >= sizes[rows]).any():
            raise WebpError("a symbol is not in its alphabet")
        out[rows, first] = 1
        out[rows[two == 1], second[two == 1]] = 1
    rows = np.flatnonzero(~simple)
    if not len(rows):
        return out
    own, n = who[rows], r.bits(who[rows], 4) + 4
    inner = np.zeros((len(rows), 19), np.int64)
    for i, symbol in enumerate(LENGTH_ORDER):
        some = np.flatnonzero(n > i)
        inner[some, symbol] = r.bits(own[some], 3)
    codes = Codes.of(inner)
    limited = r.bits(own, 1) == 1
    field = np.where(limited, 2 + 2 * r.bits(own, np.where(limited, 3, 0)), 0)
    left = np.where(limited, 2 + r.bits(own, field), sizes[rows])
    if (left > sizes[rows]).any():
        raise WebpError("more code lengths than symbols")
    at, before, size = np.zeros(len(rows), np.int64), np.full(len(rows), 8), sizes[rows]
    act = np.flatnonzero((left > 0) & (at < size))
    while len(act):
        window = r.peek(own[act])
        s, used = _symbol(window, codes, act)
        extra = REPEAT_BITS[s]
        r.at[own[act]] += used + extra
        left[act] -= 1
        here, most = at[act], size[act]
        at[act] = upto = here + REPEATS[s] + (window >> used.view(np.uint64) & (1 << extra).view(np.uint64) - ONE).view(np.int64)
        if (upto > most).any():
            raise WebpError("code lengths run over the end")
        value = np.flatnonzero((s > 0) & (s < 16))
        out[rows[act[value]], here[value]] = before[act[value]] = s[value]
        again = np.flatnonzero(s == 16)
        if len(again):
            lanes, times = act[again], (upto - here)[again]
            out[np.repeat(rows[lanes], times), np.repeat(here[again], times) + spread(times)] = np.repeat(before[lanes], times)
        act = act[(left[act] > 0) & (upto < most)]
    return out


def _value(r: Reader, who: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """A length or distance from its prefix symbol."""
    extra = np.where(symbol < 4, 0, (symbol - 2) >> 1)
    return np.where(symbol < 4, symbol, (2 + (symbol & 1)) << extra) + r.bits(who, extra) + 1


def _read_image(r: Reader, who: np.ndarray, width: np.ndarray, height: np.ndarray, top: bool) -> list[np.ndarray]:
    """Entropy-coded pixels of one image per stream."""
    lanes = np.arange(len(who))
    cached = r.bits(who, 1) == 1
    cache_bits = r.bits(who, np.where(cached, 4, 0))
    if (cached & ((cache_bits < 1) | (cache_bits > 11))).any():
        raise WebpError("bad size of the colour cache")
    groups, tiles, tile_bits = np.ones(len(who), np.int64), {}, np.zeros(len(who), np.int64)
    if top and (meta := np.flatnonzero(r.bits(who, 1) == 1)).size:
        tile_bits[meta] = r.bits(who[meta], 3) + 2
        found = _read_image(r, who[meta], -(-width[meta] // (1 << tile_bits[meta])), -(-height[meta] // (1 << tile_bits[meta])), False)
        for lane, image in zip(meta, found, strict=True):
            tiles[lane] = (image >> np.uint32(8) & np.uint32(0xFFFF)).astype(np.int64)
            groups[lane] = tiles[lane].max() + 1
    first_row = np.cumsum(groups) - groups
    sizes = [np.where(cached, GREEN + (1 << cache_bits), GREEN), *[np.full(len(who), n) for n in (CHANNEL, CHANNEL, CHANNEL, DISTANCES)]]
    lengths = [np.zeros((groups.sum(), s.max()), np.int64) for s in sizes]
    for g in range(groups.max()):
        some = lanes[groups > g]
        for k in range(5):
            lengths[k][first_row[some] + g] = _read_lengths(r, who[some], sizes[k][some], lengths[k].shape[1])
    codes = [Codes.of(x) for x in lengths]
    r.check(who)

    n = width * height
    start = np.cumsum(n) - n
    out, stop = np.zeros(n.sum(), np.uint32), start + n
    size = 1 << int(cache_bits.max())
    cache = np.zeros(len(who) * size, np.uint32)
    tile_all, tile_start, tile_width = np.concatenate([tiles[k] for k in sorted(tiles)]) if tiles else None, np.zeros(len(who), np.int64), np.zeros(len(who), np.int64)
    for k, offset in zip(sorted(tiles), np.cumsum([0, *[len(tiles[k]) for k in sorted(tiles)]]), strict=False):
        tile_start[k], tile_width[k] = offset, -(-width[k] // (1 << tile_bits[k]))
    # what follows holds the lanes that are not yet at their end: bit and pixel that come next, last pixel, start of the codes and of the cache
    lane = lanes[n > 0]
    at, pos, end, home, limit = r.at[who[lane]], start[lane], stop[lane], lane * size, r.end[-1] + 64
    one_group, all_cached, slot_bits = first_row[lane] << FAST, bool(cached.all()), (32 - cache_bits).astype(np.uint32)
    if all_cached and (cache_bits == cache_bits[0]).all():
        slot_bits = slot_bits[:1]

    def window_at(at: np.ndarray) -> np.ndarray:
        at = np.minimum(at, limit)
        return r.words[at >> 3] >> (at & 7).view(np.uint64)

    def remember(own: np.ndarray, home: np.ndarray, pixel: np.ndarray) -> None:
        """Pixels of lanes in order; of several in a slot the last one stays."""
        if not all_cached:
            kept = cached[own]
            own, home, pixel = own[kept], home[kept], pixel[kept]
        cache[home + cache_slot(pixel, slot_bits if len(slot_bits) == 1 else slot_bits[own])] = pixel

    while len(lane):
        base = one_group
        if tile_all is not None and len(many := np.flatnonzero(groups[lane] > 1)):
            k, base = lane[many], base.copy()
            y, x = np.divmod(pos[many] - start[k], width[k])
            base[many] += tile_all[tile_start[k] + (y >> tile_bits[k]) * tile_width[k] + (x >> tile_bits[k])] << FAST
        window = window_at(at)
        found = _found(window, codes[0], base)
        s, used = found & 0xFFFF, found >> 16
        pixel = s.astype(np.uint32)
        plain = np.flatnonzero(s < CHANNEL)
        if len(plain):
            first, row, value = used[plain], base[plain], s[plain] << 8
            rest, after = window[plain] >> first.astype(np.uint64), first.copy()
            for code, shift in CHANNELS:
                channel = _found(rest, codes[code], row)
                more = channel >> 16
                value |= (channel & 0xFF) << shift
                rest >>= more.astype(np.uint64)
                after += more
            if after.max() > 57:  # more than the bits that were read
                rest, value, after = window_at(at[plain] + first), s[plain] << 8, first.copy()
                for code, shift in CHANNELS:
                    channel = _found(rest, codes[code], row)
                    value |= (channel & 0xFF) << shift
                    rest >>= (channel >> 16).astype(np.uint64)
                    after += channel >> 16
            pixel[plain], used[plain] = value.view(np.uint32), after
        at = at + used
        stored = np.flatnonzero(s >= GREEN)
        if len(stored):
            pixel[stored] = cache[home[stored] + s[stored] - GREEN]
        if len(plain) + len(stored) == len(lane):
            out[pos] = pixel
            remember(lane, home, pixel)
            pos += 1
        else:
            literal = (s < CHANNEL) | (s >= GREEN)
            one, run = np.flatnonzero(literal), np.flatnonzero(~literal)
            out[pos[one]] = pixel[one]
            remember(lane[one], home[one], pixel[one])
            mine, row = who[lane[run]], base[run] >> FAST
            r.at[mine] = at[run]
            times = _value(r, mine, s[run].astype(np.int64) - CHANNEL)
            d, more = _symbol(r.peek(mine), codes[4], row)
            r.at[mine] += more
            d = _value(r, mine, d)
            at[run] = r.at[mine]
            near = np.minimum(d, 120) - 1
            back = np.where(d > 120, d - 120, np.maximum(1, NEAR_DX[near] + NEAR_DY[near] * width[lane[run]]))
            if (back > pos[run] - start[lane[run]]).any() or (times > end[run] - pos[run]).any():
                raise WebpError("a back-reference leaves the image")
            # what is longer than its distance repeats itself
            each, to = spread(times), np.repeat(pos[run], times)
            copied = out[to - np.repeat(back, times) + each % np.repeat(back, times)]
            out[to + each] = copied
            remember(np.repeat(lane[run], times), np.repeat(home[run], times), copied)
            pos[one] += 1
            pos[run] += times
        going = pos < end
        if not going.all():
            r.at[who[lane[~going]]] = at[~going]
            lane, at, pos, end, home, one_group = lane[going], at[going], pos[going], end[going], home[going], one_group[going]
    r.check(who)
    return [out[a : a + c] for a, c in zip(start, n, strict=True)]


def _channels(pixels: np.ndarray) -> np.ndarray:
    return pixels.astype("<u4").view(np.uint8).reshape(*pixels.shape, 4)


def _pixels(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(channels.astype(np.uint8)).view("<u4")[..., 0].astype(np.uint32)


def predicted(mode: int, left: np.ndarray, top: np.ndarray, top_right: np.ndarray, top_left: np.ndarray) -> np.ndarray:
    """The prediction of one pixel (or of many) from its neighbours, by channel."""
    a, b, c, d = (x.astype(np.int16, copy=False) for x in (left, top, top_right, top_left))
    mean = lambda x, y: (x + y) >> 1
    if mode == 0 or mode > 13:
        return np.broadcast_to(np.array([0, 0, 0, 255], np.int16), a.shape)
    if mode <= 4:
        return (a, b, c, d)[mode - 1]
    if mode == 11:
        # four sums of 16 bits side by side, each 256 more than the difference
        gain = np.ascontiguousarray(np.abs(b - d) - np.abs(a - d) + np.int16(256)).view(np.uint64)[..., 0] * np.uint64(0x0001000100010001) >> np.uint64(48)
        return np.where((gain < 1024)[..., None], a, b)
    if mode == 12:
        return np.clip(a + b - d, 0, 255)
    if mode == 13:
        m = mean(a, b)
        half = m - d
        return np.clip(m + ((half + (half < 0)) >> 1), 0, 255)
    return {5: lambda: mean(mean(a, c), b), 6: lambda: mean(a, d), 7: lambda: mean(a, b), 8: lambda: mean(d, b), 9: lambda: mean(b, c), 10: lambda: mean(mean(a, d), mean(b, c))}[mode]()


def unpredicted(images: list[np.ndarray], modes: list[np.ndarray], bits: list[int]) -> list[np.ndarray]:
    """Adds the predictions back, to all images in step.

    A pixel needs the one to its left and the row above up to the next column, so the pixels of equal
    column + 2 * row, of all rows and images, are done at the same time.
    """
    sizes = np.array([i.size for i in images], np.int64)
    offsets = np.cumsum(sizes) - sizes
    out, places, steps, kinds, widths = np.concatenate([_channels(i).reshape(-1, 4) for i in images]), [], [], [], []
    out[offsets, 3] += 255  # the first pixel: black
    for image, mode, b, at in zip(images, modes, bits, offsets, strict=True):
        height, width = image.shape
        own = out[at : at + image.size].reshape(height, width, 4)
        own[0] = np.cumsum(own[0], axis=0, dtype=np.uint8)
        own[:, 0] = np.cumsum(own[:, 0], axis=0, dtype=np.uint8)
        y, x = (i.ravel() for i in np.meshgrid(np.arange(1, height), np.arange(1, width), indexing="ij"))
        places.append(at + y * width + x)
        steps.append(x + 2 * y)
        kinds.append((mode[y >> b, x >> b] >> np.uint32(8) & np.uint32(15)).astype(np.int64))
        widths.append(np.full(len(x), width))
    place, key, width = np.concatenate(places), np.concatenate(steps) << 4 | np.concatenate(kinds), np.concatenate(widths)
    order = np.argsort(key, kind="stable")
    place, key, width = place[order], key[order], width[order]
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    for lo, hi in zip(begin, [*begin[1:], len(key)], strict=False):
        i, w = place[lo:hi], width[lo:hi]
        # right of the last column follows the first pixel of the own row
        out[i] += predicted(int(key[lo] & 15), out[i - 1], out[i - w], out[i - w + 1], out[i - w - 1]).astype(np.uint8)
    return [_pixels(out[a : a + i.size]).reshape(i.shape) for a, i in zip(offsets, images, strict=True)]


def _crossed(image: np.ndarray, e: np.ndarray, sign: int) -> np.ndarray:
    """``cross_colour`` with the element of every pixel, by channel and signed."""
    own, e = _channels(image), e.astype(np.int32)
    out, green = own.astype(np.int32), own[..., 1].view(np.int8).astype(np.int32)
    red = (out[..., 2] + sign * ((e[..., 0] * green) >> 5)) & 255
    true_red = (red if sign > 0 else out[..., 2]).astype(np.uint8).view(np.int8).astype(np.int32)
    out[..., 0] = (out[..., 0] + sign * (((e[..., 1] * green) >> 5) + ((e[..., 2] * true_red) >> 5))) & 255
    out[..., 2] = red
    return _pixels(out)


def cross_colour(image: np.ndarray, elements: np.ndarray, bits: int, sign: int = 1) -> np.ndarray:
    """Adds (sign 1: inverse) or subtracts (-1: forward) what green and red say about the other channels."""
    height, width = image.shape
    return _crossed(image, _channels(np.repeat(np.repeat(elements, 1 << bits, axis=0), 1 << bits, axis=1)[:height, :width]).view(np.int8), sign)


def _add_green(image: np.ndarray) -> np.ndarray:
    out = _channels(image).copy()
    out[..., 0] += out[..., 1]
    out[..., 2] += out[..., 1]
    return _pixels(out)


def bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _unpalette(image: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    bits = bundle_bits(len(palette))
    index = (image >> np.uint32(8) & np.uint32(255)).astype(np.int64)
    if bits:
        each = 8 >> bits
        index = (index[:, :, None] >> (each * np.arange(1 << bits)) & ((1 << each) - 1)).reshape(len(image), -1)[:, :width]
    return np.concatenate([palette, np.zeros(1, np.uint32)])[np.minimum(index, len(palette))]


def _sum_palette(entries: np.ndarray) -> np.ndarray:
    return _pixels(np.cumsum(_channels(entries), axis=0, dtype=np.uint8))


def containers(data: bytes) -> list[bytes]:
    """The lossless streams of one or more files that follow each other."""
    at, out = 0, []
    while at < len(data):
        if len(data) - at < 20 or data[at : at + 4] != b"RIFF" or data[at + 8 : at + 12] != b"WEBP":
            raise WebpError("no file header")
        (size,) = struct.unpack_from("<I", data, at + 4)
        end, inner, found = at + 8 + size, at + 12, None
        if end > len(data):
            raise WebpError("the file ends too early")
        while inner + 8 <= end:
            name, (n,) = data[inner : inner + 4], struct.unpack_from("<I", data, inner + 4)
            if inner + 8 + n > end:
                raise WebpError("a chunk leaves the file")
            if name == b"VP8L" and found is None:
                found = data[inner + 8 : inner + 8 + n]
            inner += 8 + n + (n & 1)
        if found is None:
            raise WebpError("no lossless stream")
        out.append(found)
        at = end + (size & 1)
    return out


def decode_streams(streams: list[bytes]) -> list[np.ndarray]:
    """Pixel arrays (height, width) of 32-bit ARGB of lossless streams; all streams advance together."""
    if not streams:
        return []
    r, who = Reader(streams), np.arange(len(streams))
    if (r.bits(who, 8) != SIGNATURE).any():
        raise WebpError("no signature")
    width, height = r.bits(who, 14) + 1, r.bits(who, 14) + 1
    r.bits(who, 1)
    if r.bits(who, 3).any():
        raise WebpError("unknown version")
    inner, todo, act = width.copy(), [[] for _ in streams], who
    while len(act := act[r.bits(act, 1) == 1]):
        kind = r.bits(act, 2)
        for lane, k in zip(act, kind, strict=True):
            if k in (t[0] for t in todo[lane]):
                raise WebpError("a transform is used twice")
        for k in (PREDICTOR, CROSS_COLOUR):
            if len(some := act[kind == k]):
                bits = r.bits(some, 3) + 2
                size = lambda x: -(-x[some] // (1 << bits))  # noqa: B023, E731
                for lane, b, image in zip(some, bits, _read_image(r, some, size(inner), size(height), False), strict=True):
                    todo[lane].append((k, int(b), image.reshape(-(-int(height[lane]) // (1 << b)), -1), int(inner[lane])))
        for lane in act[kind == SUBTRACT_GREEN]:
            todo[lane].append((SUBTRACT_GREEN, 0, None, int(inner[lane])))
        if len(some := act[kind == PALETTE]):
            colours = r.bits(some, 8) + 1
            for lane, entries in zip(some, _read_image(r, some, colours, np.ones_like(colours), False), strict=True):
                todo[lane].append((PALETTE, 0, _sum_palette(entries), int(inner[lane])))
                inner[lane] = -(-int(inner[lane]) // (1 << bundle_bits(len(entries))))
    out = [image.reshape(int(h), -1) for image, h in zip(_read_image(r, who, inner, height, True), height, strict=True)]
    while left := [lane for lane in who if todo[lane]]:
        # the last transform of each stream that has one left; those with predictions together
        some = [(lane, *todo[lane].pop()) for lane in left]
        guessed = [x for x in some if x[1] == PREDICTOR]
        if guessed:
            back = unpredicted([out[x[0]] for x in guessed], [x[3] for x in guessed], [x[2] for x in guessed])
            for x, image in zip(guessed, back, strict=True):
                out[x[0]] = image
        for lane, kind, bits, data, own in some:
            if kind == CROSS_COLOUR:
                out[lane] = cross_colour(out[lane], data, bits)
            elif kind == SUBTRACT_GREEN:
                out[lane] = _add_green(out[lane])
            elif kind == PALETTE:
                out[lane] = _unpalette(out[lane], data, own)
    return out


# --- writing -----------------------------------------------------------------------------------

@dataclass
class Fields:
    """Bit fields of many streams in order: value, number of bits, and how many fields each stream has."""

    value: np.ndarray
    bits: np.ndarray
    counts: np.ndarray

    @classmethod
    def fixed(cls, lanes: int, value, bits) -> Fields:
        """The same field in every stream; the number of bits may differ."""
        return cls(np.full(lanes, value, np.uint64), np.broadcast_to(np.asarray(bits, np.int64), lanes).copy(), np.ones(lanes, np.int64))

    @classmethod
    def woven(cls, parts: list[Fields]) -> Fields:
        """For each stream the fields of all parts in order."""
        counts = sum(p.counts for p in parts)
        value, bits = np.zeros(counts.sum(), np.uint64), np.zeros(counts.sum(), np.int64)
        at = np.cumsum(counts) - counts
        for p in parts:
            where = np.repeat(at, p.counts) + spread(p.counts)
            value[where], bits[where] = p.value, p.bits
            at = at + p.counts
        return cls(value, bits, counts)

    def packed(self) -> list[bytes]:
        """The bytes of each stream, least bit first, filled up with zeros."""
        upto = np.concatenate([[0], np.cumsum(self.bits)])
        ends = np.cumsum(self.counts)
        begin = upto[ends - self.counts]
        size = (upto[ends] - begin + 7) // 8
        first = np.cumsum(size) - size
        at = upto[:-1] + np.repeat(first * 8 - begin, self.counts)
        # fields follow each other, so those that begin in the same 64 bits are neighbours, and one at most goes on into the next
        some = np.flatnonzero(self.bits)
        at, value = at[some], self.value[some]
        word, low = at >> 6, (at & 63).view(np.uint64)
        out = np.zeros(int(size.sum()) // 8 + 2, np.uint64)
        begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]][: len(word)])
        if len(begin):
            out[word[begin]] = np.bitwise_or.reduceat(value << low, begin)
        over = np.flatnonzero((low.view(np.int64) + self.bits[some]) > 64)
        out[word[over] + 1] |= value[over] >> (np.uint64(64) - low[over])
        data = out.astype("<u8").tobytes()
        return [data[a : a + n] for a, n in zip(first, size, strict=True)]


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of a complete prefix code per row: rounded-up entropies, then symbols are shortened until nothing is left over."""
    rows, cols = np.nonzero(counts)
    symbols = np.bincount(rows, minlength=len(counts))
    # rare symbols count as one of 2^(FAST - 1), so that codes have up to FAST bits and are looked up at once
    least = np.where(symbols <= 1 << (FAST - 1), counts.sum(axis=1) / (1 << (FAST - 1)), 0)
    weight = np.maximum(counts[rows, cols], least[rows])
    total = np.bincount(rows, weight, len(counts))
    out = np.zeros(counts.shape, np.int8)
    out[rows, cols] = np.clip(np.ceil(np.log2(total[rows] / weight)), 1, MAX_BITS)
    several = symbols > 1
    weight = np.r_[0, 1 << (MAX_BITS - np.arange(1, MAX_BITS + 1))]
    while True:
        slack = (1 << MAX_BITS) - np.bincount(rows, weight[out[rows, cols]], len(out)).astype(np.int64)
        if not (several & (slack > 0)).any():
            return out.astype(np.int64)
        for n in range(2, MAX_BITS + 1):
            room = np.where(several, slack >> (MAX_BITS - n), 0)
            some = np.flatnonzero(room)
            if not len(some):
                continue
            at = out[some] == n
            chosen = at & (np.cumsum(at, axis=1, dtype=np.int32) <= room[some, None])
            out[some] -= chosen
            slack[some] -= chosen.sum(axis=1) << (MAX_BITS - n)


# The code for code lengths that is written: four bits for 0 to 13, five for 14, 15 and runs of 3 to 10 (17) and of 11 to 138 zeros (18).
LENGTH_BITS = np.array([4] * 14 + [5, 5, 0, 5, 5])
LENGTH_CODES = np.array([int(f"{v:04b}"[::-1], 2) for v in range(14)] + [int(v[::-1], 2) for v in ("11100", "11101", "0", "11110", "11111")], np.uint64)
LONGEST_RUN = 138


def _code_fields(lengths: np.ndarray) -> Fields:
    """One prefix code per row: simple for up to one symbol, else its lengths with runs of zeros joined."""
    lanes, size = lengths.shape
    n = (lengths > 0).sum(axis=1)
    simple, only = n <= 1, np.argmax(lengths > 0, axis=1)
    inner = sum(int(LENGTH_BITS[s]) << 3 * i for i, s in enumerate(LENGTH_ORDER))
    last = np.where(simple, 0, size - np.argmax(lengths[:, ::-1] > 0, axis=1))
    rows, cols = np.nonzero(np.arange(size)[None, :] < last[:, None])
    v = lengths[rows, cols]
    new = np.r_[True, (rows[1:] != rows[:-1]) | ((v[1:] == 0) != (v[:-1] == 0))][: len(v)]
    start = np.flatnonzero(new)
    run = np.diff(np.r_[start, len(v)])[np.cumsum(new) - 1]
    place = np.arange(len(v)) - start[np.cumsum(new) - 1]
    # runs of zeros in pieces
    piece = np.minimum(run - place // LONGEST_RUN * LONGEST_RUN, LONGEST_RUN)
    joined = np.where((v == 0) & (piece >= 3), piece, 0)
    kept = (joined == 0) | (place % LONGEST_RUN == 0)
    joined = joined[kept]
    token = np.where(joined >= 11, 18, np.where(joined > 0, 17, v[kept]))
    extra = (joined - np.where(token == 18, 11, np.where(token == 17, 3, joined))).astype(np.uint64)
    listed = Fields(LENGTH_CODES[token] | extra << np.uint64(5), LENGTH_BITS[token] + REPEAT_BITS[token], np.bincount(rows[kept], minlength=lanes))
    head = Fields(np.where(simple, 1 | (only > 1) << 2 | only << 3, 15 << 1).astype(np.uint64), np.where(simple, np.where(only > 1, 11, 4), 5), np.ones(lanes, np.int64))
    codes = Fields.fixed(lanes, inner, np.where(simple, 0, 57))
    codes.value[simple] = 0
    limit = Fields(np.where(simple, 0, 1 | 4 << 1 | (listed.counts - 2) << 4).astype(np.uint64), np.where(simple, 0, 14), np.ones(lanes, np.int64))
    return Fields.woven([head, codes, limit, listed])


def _code_bits(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits to write for each symbol of each row, first bit lowest, and their number (none for an only symbol)."""
    several = (lengths > 0).sum(axis=1) > 1
    own = np.where(several[:, None], lengths, 0)
    rows, cols = np.nonzero(own)
    n = own[rows, cols]
    order = np.lexsort((cols, n, rows))
    rows, cols, n = rows[order], cols[order], n[order]
    step = 1 << (MAX_BITS - n)
    upto = np.cumsum(step) - step
    head = np.searchsorted(rows, rows)
    value = np.zeros(own.shape, np.uint64)
    value[rows, cols] = REVERSED[upto - upto[head]]
    return value, own


#: Bits that a cache hit, a literal and a copy take, about, and the code of the distances: a copy is written where it saves some.
HIT_COST, LITERAL_COST, COPY_COST, CODE_COST = 7, 17, 26, 60
MOST_COPIED = 4096


def _copies(pixels: np.ndarray, lane: np.ndarray, sizes: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, length, distance) of back-references that do not overlap, in order.

    Three pixels that occurred before in the same image are a match with the latest place; matches at the
    same distance that follow each other are one copy.
    """
    none = np.zeros(0, np.int64)
    if len(pixels) < 4:
        return none, none, none
    ends = np.cumsum(sizes)
    with np.errstate(over="ignore"):
        mixed = lambda x, k: x.astype(np.uint64) * np.uint64(k)
        key = mixed(pixels[:-2], 0x9E3779B97F4A7C15) + mixed(pixels[1:-1], 0xC2B2AE3D27D4EB4F) + mixed(pixels[2:], 0x165667B19E3779F9) + mixed(lane[:-2], 0xD6E8FEB86659FD93)
        slot = (key * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(42)).view(np.int64)
    often = np.flatnonzero((np.bincount(slot, minlength=1 << 22)[slot] > 1) & (np.arange(len(key)) + 2 < ends[lane[:-2]]))
    often = often[np.argsort(key[often], kind="stable")]
    before, place = often[:-1], often[1:]
    same = (key[before] == key[place]) & (lane[before] == lane[place])
    before, place = before[same], place[same]
    same = (pixels[before] == pixels[place]) & (pixels[before + 1] == pixels[place + 1]) & (pixels[before + 2] == pixels[place + 2])
    distance = np.zeros(len(pixels), np.int64)
    distance[place[same]] = (place - before)[same]
    place = np.flatnonzero(distance)
    if not len(place):
        return none, none, none
    far = distance[place]
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1] + 1) | (far[1:] != far[:-1])])
    begin, far = place[new], far[new]
    end = place[np.r_[new[1:], len(place)] - 1] + 3
    begin = np.maximum(begin, np.r_[0, np.maximum.accumulate(end)[:-1]])
    cost = np.r_[0, np.cumsum(np.where(hit, HIT_COST, LITERAL_COST))]
    saved = np.where(end - begin >= 3, cost[end] - cost[np.minimum(begin, end)] - COPY_COST, 0)
    saved = np.maximum(saved, 0)
    whose = lane[place[new]]
    kept = (saved > 0) & (np.bincount(whose, saved, len(sizes)) > CODE_COST)[whose]
    begin, length, far = begin[kept], (end - begin)[kept], far[kept]
    pieces = -(-length // MOST_COPIED)
    step = spread(pieces) * MOST_COPIED
    return np.repeat(begin, pieces) + step, np.minimum(np.repeat(length, pieces) - step, MOST_COPIED), np.repeat(far, pieces)


def _distance_codes(distance: np.ndarray, width: int | None) -> np.ndarray:
    """The code of each distance; without a width only the pixel to the left has a short one."""
    far = distance + 120
    if width is None:
        return np.where(distance == 1, 2, far)
    near = np.maximum(1, NEAR_DX + NEAR_DY * width)
    own, first = np.unique(near, return_index=True)
    first[own == 1] = 1  # the pixel to the left, in images of any width
    at = np.minimum(np.searchsorted(own, distance), len(own) - 1)
    return np.where(own[at] == distance, first[at] + 1, far)


def _prefixes(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, number of extra bits, extra bits) of lengths and distance codes."""
    v = value - 1
    high = np.where(v < 4, 0, np.floor(np.log2(np.maximum(v, 1))).astype(np.int64))
    symbol = np.where(v < 4, v, 2 * high + (v >> np.maximum(high - 1, 0) & 1))
    bits = np.where(v < 4, 0, high - 1)
    return symbol, bits, v - np.where(v < 4, v, (2 + (symbol & 1)) << bits)


def entropy_fields(pixels: np.ndarray, sizes: np.ndarray, cache_bits: int, top: bool, width: int | None = None) -> Fields:
    """Entropy-coded images of sizes[i] pixels: literals, cache hits, and back-references."""
    lanes = len(sizes)
    lane = np.repeat(np.arange(lanes), sizes)
    symbol = (pixels >> np.uint32(8) & np.uint32(255)).astype(np.int64)
    hit = np.zeros(len(pixels), bool)
    if cache_bits:
        slot = cache_slot(pixels, np.uint32(32 - cache_bits)).astype(np.int64)
        key = lane << cache_bits | slot
        if lanes << cache_bits <= 1 << 16:
            key = key.astype(np.uint16)  # sorted faster
        order = np.argsort(key, kind="stable")
        hit[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (pixels[order[1:]] == pixels[order[:-1]])
        symbol = np.where(hit, GREEN + slot, symbol)
    green_size = GREEN + (1 << cache_bits if cache_bits else 0)
    begin, length, distance = _copies(pixels, lane, sizes, hit)
    inside = np.zeros(len(pixels) + 1, np.int8)
    np.add.at(inside, begin, 1)
    np.add.at(inside, begin + length, -1)
    kept, copy = np.cumsum(inside[:-1], dtype=np.int8) == 0, np.zeros(len(pixels), bool)
    kept[begin], copy[begin] = True, True
    (size_symbol, size_bits, size_extra), (far_symbol, far_bits, far_extra) = _prefixes(length), _prefixes(_distance_codes(distance, width))
    symbol[begin] = CHANNEL + size_symbol
    px, lane, symbol, copy = pixels[kept], lane[kept], symbol[kept], copy[kept]
    literal = ~(hit[kept] | copy)
    count = lambda rows, values, size: np.bincount(rows * size + values, minlength=lanes * size).reshape(lanes, size)
    shift = lambda s: (px[literal] >> np.uint32(s) & np.uint32(255)).astype(np.int64)
    rgb, who, runs = [shift(16), shift(0), shift(24)], lane[literal], lane[copy]
    counts = [count(lane, symbol, green_size), *[count(who, c, CHANNEL) for c in rgb], count(runs, far_symbol, DISTANCES)]
    lengths = [code_lengths(c) for c in counts]
    bits = [_code_bits(x) for x in lengths]
    value, used = np.zeros((len(px), 2), np.uint64), np.zeros((len(px), 2), np.int64)
    value[:, 0], used[:, 0] = bits[0][0][lane, symbol], bits[0][1][lane, symbol]
    total, joined = np.zeros(len(who), np.int64), np.zeros(len(who), np.uint64)
    for channel, (v, n) in zip(rgb, bits[1:4], strict=True):
        joined |= v[who, channel] << total.astype(np.uint64)
        total += n[who, channel]
    value[literal, 1], used[literal, 1] = joined, total
    value[copy, 0] |= size_extra.astype(np.uint64) << used[copy, 0].astype(np.uint64)
    value[copy, 1] = bits[4][0][runs, far_symbol] | far_extra.astype(np.uint64) << bits[4][1][runs, far_symbol].astype(np.uint64)
    used[copy, 0], used[copy, 1] = used[copy, 0] + size_bits, bits[4][1][runs, far_symbol] + far_bits
    tokens = Fields(value.ravel(), used.ravel(), 2 * np.bincount(lane, minlength=lanes))
    head = [Fields.fixed(lanes, 1 | cache_bits << 1 if cache_bits else 0, 5 if cache_bits else 1)] + ([Fields.fixed(lanes, 0, 1)] if top else [])
    return Fields.woven([*head, *[_code_fields(x) for x in lengths], tokens])


def _file(stream: bytes) -> bytes:
    body = stream + bytes(len(stream) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(body)) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + body


def _header(width: int, height: np.ndarray) -> list[Fields]:
    n = len(height)
    return [Fields.fixed(n, SIGNATURE | (width - 1) << 8, 22), Fields(((height - 1) | 1 << 14).astype(np.uint64), np.full(n, 18), np.ones(n, np.int64))]


# What the writer may do to the pixels of an image without a palette, in this order.
CHOICES = ((), (SUBTRACT_GREEN,), (CROSS_COLOUR,), (PREDICTOR,), (PREDICTOR, CROSS_COLOUR), (PREDICTOR, SUBTRACT_GREEN))
TILE_BITS = 4
#: Bits that a transform takes, about, without its tiles.
TRANSFORM_COST = 60
#: Predictions are tried with other transforms where alone they take up to so many times the bits of the plain image.
NEAR_ENOUGH = 1.25


def _take_green(pixels: np.ndarray) -> np.ndarray:
    out = _channels(pixels).copy()
    out[..., 0] -= out[..., 1]
    out[..., 2] -= out[..., 1]
    return _pixels(out)


class Grid:
    """The tiles of images of one width that follow each other."""

    def __init__(self, heights: np.ndarray, width: int):
        place = spread(heights)
        self.width, self.rows, self.first_row = width, len(place), place == 0
        self.column, self.row = np.arange(0, width, 1 << TILE_BITS), np.flatnonzero(place & ((1 << TILE_BITS) - 1) == 0)
        self.counts = -(-heights // (1 << TILE_BITS)) * len(self.column)
        self.row_of, self.column_of = np.cumsum(place & ((1 << TILE_BITS) - 1) == 0) - 1, np.arange(width) >> TILE_BITS

    def sums(self, values: np.ndarray) -> np.ndarray:
        """(rows of tiles, columns of tiles) of a value per pixel"""
        return np.add.reduceat(np.add.reduceat(values.reshape(self.rows, self.width), self.column, axis=1), self.row, axis=0)

    def each(self, tiles: np.ndarray) -> np.ndarray:
        """A value per pixel of one per tile."""
        return tiles[self.row_of][:, self.column_of].ravel()


def predict(pixels: np.ndarray, grid: Grid) -> tuple[np.ndarray, np.ndarray]:
    """The pixels less their predictions, and the modes: in each tile that of 14 with the smallest differences."""
    own, width = _channels(pixels), grid.width
    shifted = lambda by: np.concatenate([np.zeros((by, 4), np.uint8), own])[: len(own)]
    near8 = [shifted(by) for by in (1, width, width - 1, width + 1)]
    near = [x.astype(np.int16) for x in near8]
    first = np.arange(grid.rows) * width
    edge = np.zeros(len(pixels), bool)
    edge.reshape(grid.rows, width)[grid.first_row] = True
    edge[first] = True
    half, made, costs = np.uint32(0x00FF00FF), [], []
    for mode in range(14):
        rest = own - predicted(mode, *near).astype(np.uint8)
        made.append(rest.view("<u4")[:, 0])
        size = np.minimum(rest, -rest).view("<u4")[:, 0]
        size = (size & half) + (size >> np.uint32(8) & half)
        size = (size & np.uint32(0xFFFF)) + (size >> np.uint32(16))
        size[edge] = 0
        costs.append(grid.sums(size))
    modes = np.argmin(costs, axis=0)
    rest = np.choose(grid.each(modes.astype(np.int8)), made)
    # the first row is predicted from the left, the first column from above, the first pixel is black
    guess = near8[0]
    guess[first] = near8[1][first]
    guess[first[grid.first_row]] = (0, 0, 0, 255)
    rest[edge] = (own - guess).view("<u4")[edge, 0]
    return rest.astype(np.uint32), (modes.astype(np.uint32) << np.uint32(8) | np.uint32(0xFF000000)).ravel()


def cross(pixels: np.ndarray, grid: Grid) -> tuple[np.ndarray, np.ndarray]:
    """The pixels less what green and red say about the other channels, and the elements: in each tile the slopes of the regressions."""
    blue, green, red = (_channels(pixels)[:, k].view(np.int8).astype(np.int32) for k in range(3))
    n = grid.sums(np.ones(len(pixels), np.int32))

    def slope(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        sx, sy = grid.sums(x), grid.sums(y)
        var = n * grid.sums(x * x).astype(np.float64) - sx * sx.astype(np.float64)
        return np.clip(np.rint(32 * (n * grid.sums(x * y).astype(np.float64) - sx * sy.astype(np.float64)) / np.maximum(var, 1)), -128, 127).astype(np.int8)

    to_red, to_blue = slope(green, red), slope(green, blue)
    red_to_blue = slope(red, blue - ((grid.each(to_blue).astype(np.int32) * green) >> 5))
    e = np.stack([to_red, to_blue, red_to_blue, np.full(to_red.shape, -1, np.int8)], axis=-1)
    return _crossed(pixels, grid.each(e.view("<u4")[..., 0]).view(np.int8).reshape(-1, 4), -1), e.view("<u4").ravel().astype(np.uint32)


def transformed(pixels: np.ndarray, grid: Grid, kinds: tuple[int, ...]) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """The pixels after the transforms, and the tiles of each transform."""
    tiles: list[np.ndarray | None] = []
    for kind in kinds:
        if kind == SUBTRACT_GREEN:
            pixels, data = _take_green(pixels), None
        else:
            pixels, data = (predict if kind == PREDICTOR else cross)(pixels, grid)
        tiles.append(data)
    return pixels, tiles


def _literal_bits(pixels: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What the four channels of each image take by their entropies, about, prefix codes included."""
    key = np.repeat(np.arange(len(sizes)) << 8, sizes)
    k = np.arange(sizes.max() + 1)
    cost = 5.0 * (k > 0) - k * np.log2(np.maximum(k, 1))
    channels = _channels(pixels)
    taken = [cost[np.bincount(key | channels[:, k], minlength=len(sizes) << 8)].reshape(len(sizes), -1).sum(axis=1) for k in range(4)]
    return 4 * sizes * np.log2(sizes) + sum(taken)


def best_transforms(pixels: np.ndarray, heights: np.ndarray, width: int) -> np.ndarray:
    """For each image the place in ``CHOICES`` of what makes it smallest, by the entropies of its channels.

    What follows the predictions is looked at where these alone come near the plain image.
    """
    grid, sizes = Grid(heights, width), heights * width
    cost = {SUBTRACT_GREEN: 3, CROSS_COLOUR: TRANSFORM_COST + 8 * grid.counts, PREDICTOR: TRANSFORM_COST + 2 * grid.counts}
    found = np.full((len(CHOICES), len(sizes)), np.inf)

    def look(choice: int, pixels: np.ndarray, some: np.ndarray) -> None:
        found[choice, some] = _literal_bits(pixels, sizes[some]) + sum(np.broadcast_to(cost[k], len(sizes))[some] for k in CHOICES[choice])

    every = np.arange(len(sizes))
    guessed, _ = predict(pixels, grid)
    for choice, made in enumerate((pixels, _take_green(pixels), cross(pixels, grid)[0], guessed)):
        look(choice, made, every)
    near = found[3] < NEAR_ENOUGH * found[0]
    if near.any():
        some, guessed = np.flatnonzero(near), guessed[np.repeat(near, sizes)]
        look(4, cross(guessed, Grid(heights[some], width))[0], some)
        look(5, _take_green(guessed), some)
    return np.argmin(found, axis=0)


def _streams(pixels: np.ndarray, heights: np.ndarray, width: int, cache_bits: int, kinds: tuple[int, ...]) -> list[bytes]:
    """Streams of images without palettes, all with the same transforms."""
    n, parts = len(heights), _header(width, heights)
    grid = Grid(heights, width)
    pixels, tiles = transformed(pixels, grid, kinds)
    for kind, data in zip(kinds, tiles, strict=True):
        if data is None:
            parts.append(Fields.fixed(n, 1 | kind << 1, 3))
        else:
            parts += [Fields.fixed(n, 1 | kind << 1 | (TILE_BITS - 2) << 3, 6), entropy_fields(data, grid.counts, 0, False, len(grid.column))]
    return Fields.woven([*parts, Fields.fixed(n, 0, 1), entropy_fields(pixels, heights * width, cache_bits, True, width)]).packed()


def encode_images(pixels: np.ndarray, heights: np.ndarray, width: int, cache_bits: int = 6, max_palette: int = 16) -> list[bytes]:
    """Files of images of one width that follow each other in ``pixels``.

    Images of few colours get a palette. The others are written plain, and where the entropies promise less also with the best of
    ``CHOICES``: predictions, cross-colour, green subtracted; the shorter stream is kept.
    """
    sizes = heights * width
    starts = np.cumsum(sizes) - sizes
    head = np.sort(pixels[starts[:, None] + np.arange(min(width, 4 * max_palette))], axis=1)  # the first row tells most images
    few = (head[:, 1:] != head[:, :-1]).sum(axis=1) < max_palette
    few[few] = [len(np.unique(pixels[a : a + n])) <= max_palette for a, n in zip(starts[few], sizes[few], strict=True)]
    out: list[bytes] = [b""] * len(sizes)
    if (~few).any():
        some, own = np.flatnonzero(~few), pixels[np.repeat(~few, sizes)]
        streams = _streams(own, heights[some], width, cache_bits, ())
        best = best_transforms(own, heights[some], width)
        for k in np.unique(best[best > 0]):
            which = best == k
            tried = _streams(own[np.repeat(which, sizes[some])], heights[some[which]], width, cache_bits, CHOICES[k])
            for i, data in zip(np.flatnonzero(which), tried, strict=True):
                streams[i] = min(streams[i], data, key=len)
        for i, data in zip(some, streams, strict=True):
            out[i] = _file(data)
    small = np.flatnonzero(few)
    if len(small):
        palettes, rows, widths = [], [], []
        for i in small:
            palette, index = np.unique(pixels[starts[i] : starts[i] + sizes[i]], return_inverse=True)
            bits = bundle_bits(len(palette))
            index = index.reshape(int(heights[i]), width)
            index = np.pad(index, ((0, 0), (0, -width % (1 << bits))))
            bundled = (index.reshape(len(index), -1, 1 << bits) << ((8 >> bits) * np.arange(1 << bits))).sum(axis=2)
            rows.append((bundled.ravel() << 8 | 0xFF << 24).astype(np.uint32))
            channels = _channels(palette)
            palettes.append(_pixels(np.diff(channels, axis=0, prepend=np.zeros((1, 4), np.uint8))))
        n = np.array([len(x) for x in palettes])
        fields = Fields.woven([
            *_header(width, heights[small]), Fields((1 | PALETTE << 1 | (n - 1) << 3).astype(np.uint64), np.full(len(n), 11), np.ones(len(n), np.int64)),
            entropy_fields(np.concatenate(palettes), n, 0, False), Fields.fixed(len(n), 0, 1),
            entropy_fields(np.concatenate(rows), np.array([len(x) for x in rows]), cache_bits, True),
        ])
        for i, data in zip(small, fields.packed(), strict=True):
            out[i] = _file(data)
    return out
