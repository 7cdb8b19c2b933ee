"""Main text of web pages: suffix arrays over the pages of a host find what repeats from page to page."""
from __future__ import annotations

import html as character_references
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .collocations import _packed, _unpacked
from .common import table, unused
from .shingles import MULTIPLIER, WordHashes, hashed, mix

# Names of HTML elements by what they do to the text inside or around them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
APART = frozenset("aside audio button canvas datalist dialog fieldset footer form head menu nav noscript object search select svg template video".split())
# Words of class and id attributes, or of the role, that name what is not the article.
NOT_MAIN = frozenset(
    "ad ads advert adverts advertisement advertising advertorial banner breadcrumb breadcrumbs byline cookie cookies consent complementary contentinfo disqus footer gdpr hidden login menu "
    "modal nav navbar navigation newsletter notice notices outbrain overlay pager pagination popup promo promoted promotion recommended related reply replies search share sharing sidebar "
    "signup skip social sponsor sponsored sponsors subscribe subscription taboola toolbar tooltip widget widgets".split()
)
HEADER = frozenset(["header", "masthead"])
OPEN, WHOLE, ARTICLE, OUT = 0, 1, 2, 3
#: Pages whose substrings meet in one bucket, on average.
BUCKET_PAGES = 2048
#: Bits of a key that travel, beside its bucket: of a million keys in a bucket one in 64 meets another by chance.
KEY_BITS = 26
#: Hashes of the words that a task has met.
KNOWN = WordHashes()
KNOWN.BOUND = 200_000
#: Their buffers are made once per task.
PACKER, UNPACKER = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()

TAG = re.compile(r"<(?:!--|[!?]|(/?)([A-Za-z][^\s/>]*))")
QUOTE_OR_END = re.compile(r"[>\"']")
NAMES = re.compile(r"\b(class|id|role|style|aria-hidden|hidden)\b\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
PLAIN = re.compile(r"[a-z0-9]+")


def _tag_end(page: str, at: int, never: set[str]) -> int:
    """The place of the '>' that ends a tag; quoted values may hold one. -1 if there is none. ``never``: quotes that do not occur again."""
    while found := QUOTE_OR_END.search(page, at):
        sign, at = found[0], found.end()
        if sign == ">":
            return found.start()
        if page[max(0, found.start() - 8) : found.start()].rstrip().endswith("="):
            close = -1 if sign in never else page.find(sign, at)
            if close < 0:
                never.add(sign)
            else:
                at = close + 1
    return -1


def _marked(attributes: str, inside: int, name: str) -> int:
    """What the class, id, role and visibility of an element say: OUT, ARTICLE, WHOLE, or as outside."""
    if name in ("html", "body"):
        return inside
    for what, value in NAMES.findall(attributes):
        what, value = what.lower(), value.strip("\"'").lower()
        if what == "hidden" or what == "aria-hidden" and value == "true" or what == "style" and "display:none" in value.replace(" ", ""):
            return OUT
        if what in ("class", "id", "role"):
            for word in PLAIN.findall(value):
                if word in NOT_MAIN or word.startswith("comment") or word in HEADER and inside != ARTICLE:
                    return OUT
            if what == "role" and value in ("article", "main"):
                return ARTICLE if value == "article" else max(inside, WHOLE)
    return inside


class _Frame:
    """An open block element: its name, where its text belongs, and the inline elements open in it."""

    def __init__(self, name: str, area: int):
        self.name, self.area, self.inline, self.open = name, area, [], {}


def blocks_of(page: str) -> list[tuple[int, list[str], int]]:
    """(area, words, words inside links) of the visible blocks of a page, in order.

    Tolerant of what browsers tolerate: missing and misplaced end tags, references without a
    semicolon, unquoted values, an unclosed comment. Reads the page once.
    """
    out: list[tuple[int, list[str], int]] = []
    frames, many, never = [_Frame("", OPEN)], {}, set()
    text: list[str] = []
    anchors: list[str] = []
    links = at = 0
    area = OPEN

    def end_block() -> None:
        if text:
            words = character_references.unescape("".join(text)).split()
            if words:
                linked = len(character_references.unescape(" ".join(anchors)).split())
                out.append((area, words, min(linked, len(words))))
            text.clear()
            anchors.clear()

    def add(piece: str) -> None:
        if piece:
            text.append(piece)
            if links:
                anchors.append(piece)

    def move(to: int) -> None:
        """Text from here on belongs to another area."""
        nonlocal area
        if to != area:
            end_block()
            area = to

    def close_frame() -> None:
        nonlocal links
        frame = frames.pop()
        many[frame.name] -= 1
        links -= frame.open.get("a", 0)

    while True:
        found = TAG.search(page, at)
        add(page[at : found.start() if found else len(page)])
        if not found:
            break
        if found[2] is None:
            end = page.find("-->", found.end() - 2) if found[0] == "<!--" else page.find(">", found.end())
            if end < 0:
                break
            at = end + (3 if found[0] == "<!--" else 1)
            continue
        end = _tag_end(page, found.end(), never)
        if end < 0:
            break
        name, attributes, at = found[2].lower(), page[found.end() : end], end + 1
        top = frames[-1]
        if found[1]:
            if name in BLOCK or name in APART:
                if many.get(name):
                    end_block()
                    while frames[-1].name != name:
                        close_frame()
                    close_frame()
                elif name == "p":
                    end_block()
            elif top.open.get(name):
                while True:
                    last, _ = top.inline.pop()
                    top.open[last] -= 1
                    links -= last == "a"
                    if last == name:
                        break
            move(frames[-1].inline[-1][1] if frames[-1].inline else frames[-1].area)
            continue
        if top.name == "head" and name not in RAW and name not in VOID and name not in ("noscript", "template"):
            close_frame()  # the body begins
            top = frames[-1]
            move(top.area)
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at) if not attributes.endswith("/") or name in ("script", "style", "title", "textarea") else None
            at = close.start() if close else len(page)
            add(" ")
            if close:
                at = page.find(">", at) + 1 or len(page)
            continue
        if name == "br":
            add(" ")
            continue
        if name in VOID:
            if name == "hr":
                end_block()
            continue
        block = name in BLOCK or name in APART
        if block:
            end_block()
            # a paragraph, list item or cell ends the one before it
            if name in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and top.name == name or top.name == "p" and name in BLOCK:
                close_frame()
                top = frames[-1]
        inside = top.inline[-1][1] if top.inline else top.area
        here = inside
        if inside != OUT:
            if name in APART or name == "header" and inside != ARTICLE:
                here = OUT
            else:
                here = _marked(attributes, inside, name) if attributes else inside
                if here != OUT:
                    here = ARTICLE if name == "article" else max(here, WHOLE) if name == "main" else here
        if block:
            frames.append(_Frame(name, here))
            many[name] = many.get(name, 0) + 1
        else:
            top.inline.append((name, here))
            top.open[name] = top.open.get(name, 0) + 1
            links += name == "a"
        move(here)
    end_block()
    return out


def suffix_groups(tokens: np.ndarray, length: int) -> np.ndarray:
    """For every suffix the number of its group in the suffix array sorted to ``length`` tokens: equal numbers, equal first tokens.

    Doubling: the order by 2h tokens is that of pairs of orders by h tokens, h places apart. Repeats
    of at least ``length`` tokens are exactly the groups of more than one suffix.
    """
    low = int(tokens.min(initial=0))
    dense = int(tokens.max(initial=0)) - low < 1 << 30  # pairs fit 64 bits
    rank, have = tokens - low if dense else np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
    while have < length:
        step = min(have, length - have)
        ahead = np.append(rank[step:] + 1, np.zeros(min(step, len(rank)), np.int64))[: len(rank)]
        rank = np.unique(rank * (int(rank.max(initial=0)) + 2) + ahead, return_inverse=True)[1].astype(np.int64)
        have += step
    return rank


def _distinct(values: np.ndarray) -> np.ndarray:
    """In ascending order."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])[: len(values)]]


def _among(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which values are wanted."""
    if not len(wanted):
        return np.zeros(len(values), bool)
    wanted = np.sort(wanted)
    return wanted[np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)] == values


def gram_numbers(streams: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, begins, number, first): the streams put together, where each begins, and their substrings of ``length`` tokens.

    ``number`` is, for every token, that of the substring which starts there, -1 where its stream ends sooner; ``first`` is the first
    place of each. A token of its own follows each stream, so no substring goes from stream to stream.
    """
    sizes = np.array([len(s) + 1 for s in streams])
    ends = np.cumsum(sizes)
    tokens = np.full(int(sizes.sum()), -1, np.int64)
    tokens[ends - 1] = -1 - np.arange(len(streams))
    inside = np.ones(len(tokens), bool)
    inside[ends - 1] = False
    tokens[inside] = np.concatenate(streams)
    starts = np.flatnonzero(np.arange(len(tokens)) + length < np.repeat(ends, sizes))
    group = suffix_groups(tokens, length)[starts]
    place = np.full(int(group.max(initial=-1)) + 1, -1, np.int64)
    place[group[::-1]] = starts[::-1]
    number = np.full(len(tokens), -1, np.int64)
    number[starts] = (np.cumsum(place >= 0) - 1)[group]
    return tokens, ends - sizes, number, place[place >= 0]


def _holders(number: np.ndarray, begins: np.ndarray, pages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of a substring's number and a page that holds it, in order of the numbers."""
    starts, n = np.flatnonzero(number >= 0), int(pages.max(initial=0)) + 1
    owner = pages[np.searchsorted(begins, starts, "right") - 1]
    return np.divmod(_distinct(number[starts] * n + owner), n)


def _masks(number: np.ndarray, begins: np.ndarray, length: int, repeated: np.ndarray) -> list[np.ndarray]:
    """Which tokens of each stream lie in a substring that ``repeated`` (per number) marks."""
    starts = np.flatnonzero(number >= 0)
    starts = starts[repeated[number[starts]]]
    edge = np.zeros(len(number) + length + 1, np.int64)
    edge[starts] += 1
    edge[starts + length] -= 1
    mask = np.cumsum(edge)[: len(number)] > 0
    return [mask[a : b - 1] for a, b in zip(begins, [*begins[1:], len(number)], strict=True)]


def covered(streams: list[np.ndarray], pages: np.ndarray, length: int, min_pages: int) -> list[np.ndarray]:
    """Which tokens of each stream lie in a substring of ``length`` tokens or more that ``min_pages`` distinct pages hold."""
    _, begins, number, first = gram_numbers(streams, length)
    held, _ = _holders(number, begins, pages)
    return _masks(number, begins, length, np.bincount(held, minlength=len(first)) >= min_pages)


def _gram_hashes(words: np.ndarray, at: np.ndarray, length: int, seed: int) -> np.ndarray:
    """64-bit hashes of the ``length`` words (hashes) from each place on."""
    out = np.full(len(at), seed, np.uint64)
    for j in range(length):
        out = mix(out * MULTIPLIER + words[at + j])
    return out


def _seed(host: str) -> int:
    return xxhash.xxh64_intdigest(host.encode("utf-8", "surrogatepass"))


def _pairs(gram: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(grams, at, n, pages): the distinct grams in ascending order, and of each its ``n`` distinct pages, listed from ``at`` on."""
    order = np.lexsort((page, gram))
    gram, page = gram[order], page[order]
    new = np.append(True, (gram[1:] != gram[:-1]) | (page[1:] != page[:-1]))[: len(gram)]
    gram, page = gram[new], page[new]
    at = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])[: len(gram)])
    return gram[at], at, np.diff(at, append=len(gram)), page


def _often(gram: np.ndarray, page: np.ndarray, min_pages: int) -> np.ndarray:
    grams, _, n, _ = _pairs(gram, page)
    return grams[n >= min_pages]


def _masks_of_host(streams: list[np.ndarray], of_word: np.ndarray, pages: np.ndarray, length: int, min_pages: int, volume: int, seed: int, elsewhere: np.ndarray) -> list[np.ndarray]:
    """Which words of each page are covered: a suffix array per volume, whose substrings meet those of the other volumes by their hashes.

    ``of_word`` are the hashes of the tokens; ``elsewhere`` those of substrings that enough pages of the host hold.
    """
    volumes, edges = [], [*range(0, max(len(streams) - volume, 0) + 1, volume), len(streams)]  # the last volume takes what is left
    for a, b in zip(edges, edges[1:]):
        tokens, begins, number, first = gram_numbers(streams[a:b], length)
        own = _gram_hashes(of_word[np.maximum(tokens, -1)], first, length, seed)
        volumes.append((begins, number, own, *_holders(number, begins, pages[a:b])))
    repeated = [elsewhere, *[own[np.bincount(held, minlength=len(own)) >= min_pages] for _, _, own, held, _ in volumes]]
    if len(volumes) > 1:
        repeated.append(_often(np.concatenate([own[held] for _, _, own, held, _ in volumes]), np.concatenate([page for *_, page in volumes]), min_pages))
    repeated = np.concatenate(repeated)
    return [m for begins, number, own, _, _ in volumes for m in _masks(number, begins, length, _among(own, repeated))]


def _host_grams(packed: list[bytes], pages: list[int], length: int, host: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, gram, page) of every substring of ``length`` words: its hash, and the smaller of the hashes of its two substrings one word shorter, scrambled.

    Equal substrings have equal keys, and neighbours often share theirs, so there are about two keys for three substrings.
    """
    words = [_word_hashes(_unpacked_words(b)[1]) for b in packed]
    sizes = np.array([len(w) for w in words])
    flat, page = np.concatenate(words), np.repeat(np.array(pages, np.int64), sizes)
    at = np.flatnonzero(np.arange(len(flat)) + length <= np.repeat(np.cumsum(sizes), sizes))
    seed = _seed(host)
    near = _gram_hashes(flat, at, length - 1, seed)
    gram = mix(near * MULTIPLIER + flat[at + length - 1])
    return mix(np.minimum(near, _gram_hashes(flat, at + 1, length - 1, seed)) if length > 1 else gram), gram, page[at]


def _word_hashes(words: list[str]) -> np.ndarray:
    return hashed(words, KNOWN)


def _cuts(bucket: np.ndarray) -> list[tuple[int, slice]]:
    """The buckets of a list in their order, and where each lies."""
    number, begin = np.unique(bucket, return_index=True)
    return [(int(b), slice(x, y)) for b, x, y in zip(number, begin, [*begin[1:], len(bucket)])]


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes & np.uint64(0xFFFFFFFF)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _to_bytes(hashes: np.ndarray) -> tuple[bytes, bytes]:
    """Hashes in ascending order, packed."""
    return _packed(np.diff((hashes >> np.uint64(32)).astype(np.int64), prepend=0)), _packed(hashes & np.uint64(0xFFFFFFFF))


def _from_bytes(high: bytes, low: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(high)).astype(np.uint64) << np.uint64(32) | _unpacked(low).astype(np.uint64)


def _rows(columns: dict[str, pa.DataType], rows: list[tuple]) -> pa.Table:
    return pa.table({c: pa.array([r[i] for r in rows], kind) for i, (c, kind) in enumerate(columns.items())})


def _repeated_elsewhere(dealt: DataFrame, keys: list[str], grams_of: Callable[[pa.Table, str], tuple[np.ndarray, np.ndarray, np.ndarray]], min_pages: int, buckets: int) -> DataFrame:
    """(keys, high, low): per part of a host the hashes of its substrings that ``min_pages`` distinct pages of the whole host hold, but not of the part alone.

    1. A part sends the keys of its substrings (``_host_grams``), cut to ``KEY_BITS``, to their buckets, as gaps; back go the places
       of those that another part sent too. No other substring can be on a page of another part.
    2. Of the substrings with such a key the whole hash and the pages are sent, of those with ``min_pages`` pages in the part
       only that; the bucket of the hash counts the distinct pages of all parts.
    """
    host, salt = keys
    part, kind = {host: pa.string(), salt: pa.int64()}, f"`{host}` string, `{salt}` long"
    named, binary = {"bucket": pa.int64(), **part}, pa.binary()
    cut, whole, found = named | {"cut": binary}, named | {"high": binary, "low": binary, "n": binary, "pages": binary}, part | {"high": binary, "low": binary}

    fewer = -(-buckets // 4)  # long messages pack better

    def codes_of(key: np.ndarray) -> np.ndarray:
        return _bucket(key, buckets) << KEY_BITS | (key >> np.uint64(64 - KEY_BITS)).astype(np.int64)

    def send(of: tuple[pa.Scalar, ...], page: pa.Table) -> pa.Table:
        at = tuple(k.as_py() for k in of)
        codes = _distinct(codes_of(grams_of(page, at[0])[0]))
        return _rows(cut, [(b, *at, _packed(np.diff(codes[i] & (1 << KEY_BITS) - 1, prepend=0))) for b, i in _cuts(codes >> KEY_BITS)])

    def compare(rows: pa.Table) -> pa.Table:
        sent = [np.cumsum(_unpacked(x)) for x in rows.column("cut").to_pylist()]
        _, back, n = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
        shared = np.split(n[back] > 1, np.cumsum([len(x) for x in sent])[:-1])
        names = zip(*[rows.column(c).to_pylist() for c in named], strict=True)
        return _rows(cut, [(*at, _packed(np.diff(np.flatnonzero(s), prepend=0))) for at, s in zip(names, shared, strict=True) if s.any()])

    def name(of: tuple[pa.Scalar, ...], page: pa.Table, answer: pa.Table) -> pa.Table:
        at = tuple(k.as_py() for k in of)
        if not answer.num_rows:
            return _rows(whole, [])
        key, gram, on = grams_of(page, at[0])
        code = codes_of(key)
        codes = _distinct(code)
        places = dict(_cuts(codes >> KEY_BITS))
        shared = _among(code, np.concatenate([codes[places[b]][np.cumsum(_unpacked(x))] for b, x in zip(answer.column("bucket").to_pylist(), answer.column("cut").to_pylist(), strict=True)]))
        grams, begin, n, by = _pairs(gram[shared], on[shared])
        order = np.argsort(_bucket(grams, fewer), kind="stable")
        grams, begin, n = grams[order], begin[order], np.where(n < min_pages, n, 0)[order]
        by = by[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        ends = np.cumsum(n)
        rows = []
        for b, i in _cuts(_bucket(grams, fewer)):
            pages = by[ends[i.start] - n[i.start] : ends[i.stop - 1]]
            rows.append((b, *at, *_to_bytes(grams[i]), _packed(n[i]), zstandard.compress(pages.tobytes(), 1)))
        return _rows(whole, rows)

    def count(rows: pa.Table) -> pa.Table:
        columns = [rows.column(c).to_pylist() for c in whole]
        sent, n = [_from_bytes(*x) for x in zip(columns[3], columns[4], strict=True)], [_unpacked(x) for x in columns[5]]
        grams, many = np.concatenate(sent), np.concatenate(n)
        often = _often(np.repeat(grams, many), np.concatenate([np.frombuffer(zstandard.decompress(x), np.int64) for x in columns[6]]), min_pages)
        asked = np.split(_among(grams, np.concatenate([often, grams[many == 0]])) & (many > 0), np.cumsum([len(x) for x in sent])[:-1])
        return _rows(found, [(h, k, *_to_bytes(x[s])) for h, k, x, s in zip(columns[1], columns[2], sent, asked, strict=True) if s.any()])

    parts = dealt.groupBy(*keys)
    answers = parts.applyInArrow(send, f"bucket long, {kind}, cut binary").groupBy("bucket").applyInArrow(compare, f"bucket long, {kind}, cut binary")
    sent = parts.cogroup(answers.groupBy(*keys)).applyInArrow(name, f"bucket long, {kind}, high binary, low binary, n binary, pages binary")
    return sent.groupBy("bucket").applyInArrow(count, f"{kind}, high binary, low binary")


def _main_text(blocks: list[tuple[int, list[str], int]], mask: np.ndarray, share: float) -> str:
    """The blocks of the article, or where none is declared those that are no boilerplate."""
    best, kept, at = max([area for area, _, _ in blocks if area != OUT], default=OPEN), [], 0
    for area, words, linked in blocks:
        repeated = int(mask[at : at + len(words)].sum())
        at += len(words)
        if area != best:
            continue
        # a declared article keeps passages that other pages share; only repeated rows of links are no text of it
        boiler = repeated >= share * len(words) if best == OPEN else linked == len(words) and repeated == len(words)
        if not boiler:
            kept.append(" ".join(words))
    return "\n".join(kept)


def host_of(url: Column) -> Column:
    """The lower-cased host of an address; '' where there is none."""
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(""))


def _pack(blocks: list[tuple[int, list[str], int]]) -> bytes:
    """A line of three numbers per block, and a line of all words."""
    numbers = " ".join(f"{area} {linked} {len(words)}" for area, words, linked in blocks)
    return PACKER.compress(f"{numbers}\n{' '.join(w for _, words, _ in blocks for w in words)}".encode("utf-8", "surrogatepass"))


def _unpacked_words(packed: bytes) -> tuple[str, list[str]]:
    numbers, words = UNPACKER.decompress(packed).decode("utf-8", "surrogatepass").split("\n")
    return numbers, words.split(" ") if words else []


def _unpack(packed: bytes) -> tuple[list[tuple[int, list[str], int]], list[str]]:
    """The blocks, and all their words."""
    numbers, words = _unpacked_words(packed)
    blocks, at, end = [], iter(map(int, numbers.split())), 0
    for area, linked, n in zip(at, at, at):
        blocks.append((area, words[end : end + n], linked))
        end += n
    return blocks, words


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", text: str = "text", n_words: str = "n_words", n_repeated: str = "n_repeated",
    min_words: int = 5, min_pages: int = 2, share: float = 0.8, volume: int = 128,
) -> DataFrame:
    """``pages`` without the html, with the main text, the number of visible words, and how many of them repeat on other pages of the host.

    The visible words of the pages of a host are put together and their suffixes sorted; a word is
    covered if it lies in a substring of ``min_words`` words or more that ``min_pages`` distinct pages of the host
    hold (equal pages are one). Where a page declares its article, the text is the article without
    the menus, forms, adverts, notices and comments inside it, and without rows of links that are
    covered; passages which articles share stay. Where it declares none, the text is what no element
    marks as something else, without the blocks of which ``share`` of the words is covered. A block's
    white space is one space, blocks are joined by \\n.

    Pages are parsed where they are read; their words are shuffled once, packed. Hosts with more than 1 / 4096 of the pages (so at
    most 4096) are dealt to parts by a hash of the id, any other host is a part. A task holds a part at a time, in volumes of
    ``volume`` pages or more with a suffix array each. Substrings of the same words in other volumes and parts are found by 64-bit
    hashes: the parts of a host exchange theirs (``_repeated_elsewhere``), so a passage counts wherever its pages were dealt. Among
    100 million different substrings of all large hosts two meet with a chance of 0.03 %.

    Cases: a null or empty page has the text ''. Pages without a host (null or broken address) are
    one host. Repeated rows and pages of a host with equal html get equal texts.
    Unclosed tags, comments and quotes end where browsers end them. A long page takes memory in proportion to its length. Other columns
    pass through; one with the name of a result is replaced. An empty table gives an empty table.
    """
    kept = [c for c in pages.columns if c.lower() not in {text.lower(), n_words.lower(), n_repeated.lower(), html_col.lower()}]
    host, salts, given, order, large_host, n_parts = (unused(pages, f"_pg_{c}") for c in ("host", "salts", "html", "order", "large", "parts"))
    at = host_of(F.col(f"`{url_col}`"))
    n_pages = pages.count()
    limit = max(volume, n_pages // 4096)
    heavy = pages.select(at.alias(large_host)).groupBy(large_host).agg(F.ceil(F.count(F.lit(1)) / limit).cast("int").alias(n_parts)).filter(F.col(n_parts) > 1)
    place = F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.lit(order))
    rows = pages.select(*[F.col(f"`{c}`") for c in kept], at.alias(host), place.alias(order), F.xxhash64(F.col(f"`{html_col}`").cast("string")).alias(given + "_"), F.col(f"`{html_col}`").cast("string").alias(given))
    lead, last = [*[F.col(f"`{c}`") for c in kept], host], [given + "_", given]
    own = ", ".join([f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [_pack(blocks_of(page.as_py() or "")) for page in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(blobs, pa.binary())], batch.schema.names)

    def dealt(some: DataFrame) -> DataFrame:
        packed = some.mapInArrow(parse, f"{own}, {host} string, {salts} long, {given}_ long, {given} binary")
        return packed.repartition(host, salts)

    def grams_of(page: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _host_grams(page.column(given).to_pylist(), page.column(given + "_").to_pylist(), min_words, name)

    def finish(page: pa.Table, name: str, elsewhere: np.ndarray) -> pa.Table:
        blocks, words = zip(*[_unpack(b) for b in page.column(given).to_pylist()], strict=True)
        known = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(words)))}
        streams = [np.fromiter(map(known.__getitem__, w), np.int64, len(w)) for w in words]
        of_word = np.append(_word_hashes(list(known)), np.uint64(0))
        who = np.unique(page.column(given + "_").to_numpy(), return_inverse=True)[1]
        masks = _masks_of_host(streams, of_word, who, min_words, min_pages, volume, _seed(name), elsewhere)
        out = page.select(kept).append_column(text, pa.array([_main_text(b, m, share) for b, m in zip(blocks, masks, strict=True)], pa.string()))
        return out.append_column(n_words, pa.array([len(m) for m in masks], pa.int64())).append_column(n_repeated, pa.array([int(m.sum()) for m in masks], pa.int64()))

    def finish_host(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole hosts, one after the other."""
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            names, begin = batch.column(host).to_pylist(), 0
            for i, name in enumerate(names):
                if name != now:
                    held.append(batch.slice(begin, i - begin))
                    if now is not None:
                        yield from finish(pa.Table.from_batches(held), now, np.zeros(0, np.uint64)).combine_chunks().to_batches()
                    held, now, begin = [], name, i
            held.append(batch.slice(begin))
        if now is not None:
            yield from finish(pa.Table.from_batches(held), now, np.zeros(0, np.uint64)).combine_chunks().to_batches()

    def finish_part(key: tuple[pa.Scalar, ...], page: pa.Table, answer: pa.Table) -> pa.Table:
        elsewhere = [_from_bytes(*x) for x in zip(answer.column("high").to_pylist(), answer.column("low").to_pylist(), strict=True)]
        return finish(page, key[0].as_py(), np.concatenate([np.zeros(0, np.uint64), *elsewhere]))

    result = f"{own}, `{text}` string, `{n_words}` bigint, `{n_repeated}` bigint"
    small = rows.join(F.broadcast(heavy), F.col(host) == F.col(large_host), "left_anti")
    out = dealt(small.select(*lead, F.lit(0).cast("long").alias(salts), *last)).sortWithinPartitions(host).mapInArrow(finish_host, result)
    large = rows.join(F.broadcast(heavy), F.col(host) == F.col(large_host))
    parts = dealt(large.select(*lead, F.pmod(F.col(order), F.col(n_parts)).cast("long").alias(salts), *last))
    buckets = -(-n_pages // BUCKET_PAGES) or 1
    answers = _repeated_elsewhere(parts, [host, salts], grams_of, min_pages, buckets)
    return out.unionAll(parts.groupBy(host, salts).cogroup(answers.groupBy(host, salts)).applyInArrow(finish_part, result))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_words", "n_repeated")
