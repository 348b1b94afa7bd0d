"""Held-out passages that leaked into a corpus of scanned pages.

Query items are a stated set, taken in blocks of bounded size; BLOCKS blocks at once run against all pages in one pass
without a shuffle, in which every page is read, put in order and folded once.  For each page:

1. the wording as printed is rebuilt from the line boxes: columns are found from where lines begin, each column is read
   from top to bottom, lines that run over several columns are cut where the next column begins, and centred lines
   (adverts) are left out;
2. page and items become streams of letters and digits, without case, accents, punctuation, blanks and line breaks, so
   that a broken word reads on;
3. Q-gram lemma: an alignment of length L within K edits leaves L + 1 - Q (K + 1) q-grams unchanged, and they lie within
   a band of diagonals.  Shared q-grams are counted in overlapping bands and stretches of the item; only regions that
   reach the lemma's number for the item's shortest passage go on, first with long q-grams, which few pages share by
   chance, then inside the band with short ones;
4. what is left is verified by banded alignment; a passage counts with the item words its alignment carries in a row.

Pages with characters of a wrong decoding are also compared by their ASCII letters alone, which wrong decodings keep.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Letters of the q-grams that seed bands and of those that are counted again inside a seeded band.
Q, FINE = 8, 4
#: Edits a passage may have, per letter; at most as many as leave MIN_SHARED seeds unchanged.
EDIT_SHARE, MIN_SHARED = 0.075, 4
#: Words in a row that make a passage, and how many of them may show no short q-gram because they are its misread ends.
WORDS, SLACK = 12, 2
#: Letters of all items of a block, at most, and blocks of one pass: together they bound what is broadcast (about 40 bytes
#: a letter).
BLOCK_LETTERS, BLOCKS = 4_000_000, 4
#: Pages whose q-grams are looked up at once.
PAGES = 256
#: Pixels within which lines begin together, and within which centres coincide.
EDGE, CENTRE = 11, 9
BASE = 37
#: Added to diagonals, which begin below zero; more where an item is longer.
_ZERO = 1 << 15
#: Bits of the hashes by which q-grams and bands are looked up first.
_TABLE_BITS, _BAND_BITS = 22, 19


def _letter_table() -> dict[int, str | None]:
    """Lower case, without accents; what isn't a letter or digit of the basic alphabet goes."""
    out: dict[int, str | None] = {}
    for code in range(0x250):
        base = "".join(ch for ch in unicodedata.normalize("NFKD", chr(code).lower()) if "0" <= ch <= "9" or "a" <= ch <= "z")
        out[code] = base if chr(code).isalnum() and not chr(code).isdigit() or chr(code) in "0123456789" else None
    out.update({ord("ß"): "ss", ord("æ"): "ae", ord("Æ"): "ae", ord("œ"): "oe", ord("Œ"): "oe", ord("ø"): "o", ord("Ø"): "o", ord("ª"): "a", ord("º"): "o"})
    return out


_FOLD = _letter_table()
_KEEP = {c: chr(c).lower() if chr(c).isalnum() else None for c in range(0x80)}
#: Letters that well decoded pages hold; others make a page be compared by its ASCII letters too.
_USUAL = "áéíóúñüàèìòùâêôîûëïçãõöäœæßøåÁÉÍÓÚÑÜÀÈÊÔÇÂÕ¡¿«»“”‘’—–-…§ºª°€£¬­‐©·"
_UNUSUAL = re.compile(f"[^\x00-\x7f{re.escape(_USUAL)}]")


class _Fold(dict):
    """A str.translate table that drops what it doesn't list."""

    def __missing__(self, key: int) -> None:
        return None


_FOLD, _KEEP = _Fold(_FOLD), _Fold(_KEEP)


def fold(text: str, ascii_only: bool = False) -> str:
    return text.translate(_KEEP if ascii_only else _FOLD)


def codes(letters: str) -> np.ndarray:
    """Numbers 1 to 36 of folded letters."""
    raw = np.frombuffer(letters.encode("ascii"), dtype=np.int8)
    return np.where(raw >= 97, raw - np.int8(86), raw - np.int8(47))


def grams(numbers: np.ndarray) -> np.ndarray:
    """The q-grams as numbers, out of those of half the length: Q is a power of two."""
    if len(numbers) < Q:
        return np.empty(0, np.int64)
    out, size = numbers.astype(np.int64), 1
    while size < Q:
        out = out[:-size] * BASE**size + out[size:]
        size *= 2
    return out


def slots(values: np.ndarray) -> np.ndarray:
    return ((values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)


@dataclass(frozen=True)
class Items:
    """One block of items in both foldings (variant 0: accents folded; 1: ASCII letters alone)."""

    ids: list
    letters: list[list[np.ndarray]]  # [variant][item] -> numbers
    all_letters: list[np.ndarray]  # [variant] those of all items
    begins: list[np.ndarray]  # [variant] where each item begins in them, and the end
    starts: list[list[np.ndarray]]  # [variant][item] -> first letter of each word
    window: np.ndarray  # [variant, item] letters of the shortest passage
    need: np.ndarray  # [variant, item] shared q-grams of the shortest passage
    edits: np.ndarray  # [variant, item] half the width of a band
    keys: list[np.ndarray]  # [variant] sorted q-grams
    first: list[np.ndarray]  # [variant] where their postings begin
    item: list[np.ndarray]
    place: list[np.ndarray]
    table: list[np.ndarray]  # [variant] which slots hold any q-gram


def index_items(rows: list[tuple], words: int = WORDS) -> Items:
    """The index of (id, text) items; items with fewer than `words` words can't leak and are left out."""
    kept = []
    for item_id, text in rows:
        tokens = [w for w in (text or "").split() if any(ch.isalnum() for ch in w)]
        if len(tokens) >= words:
            kept.append((item_id, tokens))
    letters, joined, begins, starts, keys, first, item, place, table = ([] for _ in range(9))
    window, need, edits = (np.zeros((2, len(kept)), int) for _ in range(3))
    for variant in (0, 1):
        own_letters, own_starts, g, who, where = [], [], [], [], []
        for k, (_, tokens) in enumerate(kept):
            folded = [fold(w, variant == 1) for w in tokens]
            sizes = np.array([len(w) for w in folded])
            begin = np.concatenate(([0], np.cumsum(sizes)))
            number = codes("".join(folded))
            own_letters.append(number)
            own_starts.append(begin)
            shortest = int((begin[words:] - begin[:-words]).min())
            allowed = max(1, min(int(EDIT_SHARE * shortest), (shortest + 1 - MIN_SHARED) // Q - 1))
            edits[variant, k] = allowed
            window[variant, k] = shortest
            need[variant, k] = max(1, shortest + 1 - Q * (allowed + 1))
            mine = grams(number)
            g.append(mine)
            who.append(np.full(len(mine), k))
            where.append(np.arange(len(mine)))
        all_, who_, where_ = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (g, who, where))
        order = np.argsort(all_, kind="stable")
        unique, at = np.unique(all_[order], return_index=True)
        bits = np.zeros(1 << _TABLE_BITS, bool)
        bits[slots(unique)] = True
        letters.append(own_letters)
        joined.append(np.concatenate(own_letters) if own_letters else np.empty(0, np.int8))
        begins.append(np.concatenate(([0], np.cumsum([len(x) for x in own_letters]))).astype(np.int64))
        starts.append(own_starts)
        keys.append(unique)
        first.append(np.append(at, len(all_)).astype(np.int32))
        item.append(who_[order].astype(np.int32))
        place.append(where_[order].astype(np.int32))
        table.append(bits)
    return Items([i for i, _ in kept], letters, joined, begins, starts, window, need, edits, keys, first, item, place, table)


def reading_order(lines: list[str], x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, width: float | None) -> list[str]:
    """The lines as printed, column by column, without centred ones; lines as they are where the boxes don't fit them."""
    n = len(lines)
    if len(x0) != n or n < 2:
        return lines
    # within the outermost twentieth, but never right of the middle
    margin = np.sort(x0)[max(0, min((n - 1) // 2, n // 20))]
    lefts, aligned = _columns(x0, x1, float(margin), width)
    out: list[tuple[int, int, str]] = []
    widths = (x1 - x0) / np.maximum(1, [len(s) for s in lines])
    cw = float(np.sort(widths)[(n - 1) // 2] + np.sort(widths)[n // 2]) / 2
    column = np.maximum(0, np.searchsorted(lefts, x0 + EDGE, side="right") - 1)
    edges = lefts.tolist()
    for i, (text, c, here, right, top) in enumerate(zip(lines, column.tolist(), aligned.tolist(), x1.tolist(), y0.tolist())):
        if not here:
            continue  # centred: an advert or a title of its own
        for k in range(c + 1, len(edges)):
            if right <= edges[k] + 2 * cw:
                break
            # the line runs on into column k, whose part ends the line and begins at the column's edge
            rest = int(round((right - edges[k]) / max(cw, 1e-6)))
            cut = _blank_near(text, len(text) - rest)
            if cut is None:
                break
            out.append((k - 1, int(top), text[:cut]))
            text = text[cut + 1 :]
            c = k
        out.append((c, int(top), text))
    out.sort(key=lambda r: r[:2])
    return [r[2] for r in out]


def _blank_near(text: str, at: int) -> int | None:
    best = None
    for k in (text.rfind(" ", 0, max(0, at) + 1), text.find(" ", max(0, at))):
        if k > 0 and (best is None or abs(k - at) < abs(best - at)):
            best = k
    return best


def _columns(x0: np.ndarray, x1: np.ndarray, margin: float, width: float | None) -> tuple[np.ndarray, np.ndarray]:
    """(left edges, whether each line begins at one): columns of equal width between equal margins, as many as let most
    lines begin at an edge; without a page width the page counts as one column per cluster of beginnings."""
    centre = (x0 + x1) / 2
    best = None
    if width is not None and width > 2 * margin:
        # all numbers of columns at once
        ns = np.arange(1, 9)[:, None]
        pitches = (width - 2 * margin) / ns
        nears = np.minimum(np.maximum(np.rint((x0 - margin) / pitches), 0), ns - 1)
        ons = np.abs(x0 - margin - nears * pitches) <= EDGE
        hits = ons.sum(1).tolist()
        most = -1
        for n in range(1, 9):
            if hits[n - 1] <= most:
                continue
            lefts, near, on = margin + np.arange(n) * pitches[n - 1, 0], nears[n - 1], ons[n - 1]
            if n > 1:
                real = True
                for k in range(n):
                    own = centre[on & (near == k)]
                    if not len(own):
                        real = False
                    elif k and np.ptp(own) <= 2 * CENTRE:
                        # lines of one centre may be adverts of a wider column: they are, if other lines share it
                        rest = centre[~on] if best is None else centre[~best[1] & ~(on & (near == k))]
                        real = real and not (np.abs(rest - np.median(own)) <= CENTRE).any()
                if not real:
                    continue
            best, most = (lefts, on), hits[n - 1]
        return best
    edges = np.sort(x0)
    lefts = [edges[0]]
    for x in edges:
        if x - lefts[-1] > 2 * EDGE and (np.abs(x0 - x) <= EDGE).sum() >= max(2, 0.2 * len(x0)):
            lefts.append(x)
    lefts = np.array(lefts, float)
    return lefts, (np.abs(x0[:, None] - lefts[None]) <= 2 * EDGE).any(1)


def _runs(page: bytes, item: bytes, starts: list[int], diagonal: int, band: int) -> int:
    """Most item words in a row that the best local alignment within the band carries.

    Matches +1, edits -2, and an alignment ends where it would fall below zero.  A word is carried if two thirds of its
    letters match; one of which at least two fifths match may stand between two carried ones.  A misread letter near
    either end would end the alignment early, so the word there is compared by itself.  It, and a misread word of one
    letter, count among carried words alone: beside words that match in part, chance would make up too many.
    """
    width, n, size = 2 * band + 1, len(item), len(page)
    score = [0] * (width + 1)  # one more column keeps the last one's upper neighbour
    moves: list[bytearray] = []
    best, end = 0, (0, 0)
    for i in range(n):
        letter, at = item[i], i + diagonal - band
        new, move = [0] * (width + 1), bytearray(width)
        left = 0
        for j in range(max(0, -at), min(width, size - at)):
            same = page[at + j] == letter
            s, m = score[j] + (1 if same else -2), (1 if same else 2)
            up = score[j + 1] - 2
            if up > s:
                s, m = up, 3
            if left - 2 > s:
                s, m = left - 2, 4
            if s <= 0:
                left = 0
                continue
            new[j] = left = s
            move[j] = m
            if s > best:
                best, end = s, (i, j)
        moves.append(move)
        score = new
    matched, replaced = [0] * n, set()
    i, j = begin = end
    while i >= 0 and best and moves[i][j]:
        m = moves[i][j]
        if m == 1:
            matched[i] = 1
            begin = (i, j)
        elif m == 2:
            replaced.add(i)
        if m <= 2:
            i -= 1
        elif m == 3:
            i, j = i - 1, j + 1
            if j >= width:
                break
        else:
            j -= 1
            if j < 0:
                break
    hits = [sum(matched[a:b]) for a, b in zip(starts, starts[1:])]
    sizes = [b - a for a, b in zip(starts, starts[1:])]
    carried = [2 if 3 * h >= 2 * s else 1 if 5 * h >= 2 * s else 0 for h, s in zip(hits, sizes)]
    whole = [2 * (c == 2 or s == 1 and a in replaced and matched[a - 1] == matched[a + 1] == 1) for c, s, a in zip(carried, sizes, starts)]
    if best:
        # the first word at either end that isn't carried, on the diagonal on which the alignment ends
        k = bisect.bisect_right(starts, end[0]) - 1
        k += carried[k] == 2
        if k < len(carried) and (a := starts[k] + diagonal - band + end[1]) >= 0 and _misread(item[starts[k] : starts[k + 1]], page[a : a + sizes[k] + 1]):
            whole[k] = 2
        k = bisect.bisect_right(starts, begin[0]) - 1
        k -= carried[k] == 2
        if k >= 0 and (b := starts[k + 1] + diagonal - band + begin[1]) > 0 and _misread(item[starts[k] : starts[k + 1]][::-1], page[max(0, b - sizes[k] - 1) : b][::-1]):
            whole[k] = 2
    return max(_longest(carried), _longest(whole))


def _misread(word: bytes, beside: bytes) -> bool:
    """Whether `beside` begins with the word but for one edit, or for edits of a third of its letters."""
    if not beside:
        return False
    row = list(range(len(beside) + 1))
    for i, letter in enumerate(word, 1):
        above, row = row, [i]
        for j, other in enumerate(beside, 1):
            row.append(min(above[j - 1] + (letter != other), above[j] + 1, row[-1] + 1))
    return min(row) <= max(1, len(word) // 3)


def _touched(page: np.ndarray, item: np.ndarray, starts: np.ndarray, diagonal: int, band: int) -> int:
    """At least as many words in a row as an alignment in the band can carry: words that shared short q-grams touch,
    with up to two untouched ones between."""
    n = len(item)
    beside = np.full(n + 2 * band, np.int8(-2))
    low = diagonal - band
    a, b = max(0, low), min(len(page), low + len(beside))
    if b > a:
        beside[a - low : b - low] = page[a:b]
    same = np.lib.stride_tricks.sliding_window_view(beside, n) == item[None]
    gram = same[:, : n - FINE + 1] & same[:, 1 : n - FINE + 2]
    for f in range(2, FINE):
        gram &= same[:, f : n - FINE + 1 + f]
    shared = np.nonzero(gram.any(0))[0]
    if not len(shared):
        return 0
    # first and last word of each shared q-gram
    first, last = np.searchsorted(starts, shared, "right") - 1, np.searchsorted(starts, shared + FINE - 1, "right") - 1
    cut = np.nonzero(first[1:] - last[:-1] > 3)[0]
    begin, end = first[np.append(0, cut + 1)], last[np.append(cut, len(last) - 1)]
    return int((end - begin).max()) + 1


def _longest(carried: list[int]) -> int:
    """Words of the longest run of 2s; a single 1 between 2s belongs to it."""
    best = run = gap = 0
    for c in carried:
        if c == 2:
            run += 1 + gap
            gap = 0
        elif c == 1 and run and not gap:
            gap = 1
        else:
            run = gap = 0
        best = max(best, run)
    return best


def _distinct(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of the columns, ascending, and how often each occurs; values are at least 0.

    Rows are packed into 63 bits where the largest values let them be, and else sorted by their columns."""
    bits = [int(c.max(initial=0)).bit_length() for c in columns]
    if sum(bits) <= 63:
        key = columns[0].astype(np.int64)
        for c, b in zip(columns[1:], bits[1:]):
            key = (key << b) | c
        key.sort()
        new = key[1:] != key[:-1]
    else:
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
        new = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    at = np.nonzero(np.concatenate(([True], new)))[0] if len(columns[0]) else np.empty(0, np.int64)
    times = np.diff(np.append(at, len(columns[0])))
    if sum(bits) > 63:
        return [c[at] for c in columns], times
    key, out = key[at], []
    for b in bits[:0:-1]:
        out.append(key & ((1 << b) - 1))
        key = key >> b
    return [key, *out[::-1]], times


def _refined(items: Items, variant: int, stream: np.ndarray, begin: np.ndarray, size: np.ndarray, page, item, middle, first) -> np.ndarray:
    """Which seeded regions pass the lemma with short q-grams: those of the band around `middle`, in two
    passages' length of the item from letter `first` on."""
    keep = np.zeros(len(page), bool)
    edits, window = items.edits[variant][item], items.window[variant][item]
    length = 2 * window
    letters, at_item = items.all_letters[variant], items.begins[variant]
    j = np.arange(-int(edits.max(initial=0)), int(edits.max(initial=0)) + 1)
    step = max(1, 2_000_000 // max(1, int(length.max(initial=1)) * len(j)))
    for a in range(0, len(page), step):
        s = slice(a, a + step)
        i = np.arange(int(length[s].max()))
        place = first[s, None] + i[None]
        inside = (i[None] < length[s, None]) & (place >= 0) & (place < (at_item[item[s] + 1] - at_item[item[s]])[:, None])
        own = np.where(inside, letters[np.where(inside, at_item[item[s], None] + place, 0)], np.int8(-1))
        # the page letters beside the stretch, with the band's width more on either side
        reach = np.arange(len(i) + len(j) - 1)
        on_page = (first[s] + middle[s] + j[0])[:, None] + reach[None]
        valid = (on_page >= 0) & (on_page < size[page[s], None])
        beside = np.where(valid, stream[np.where(valid, begin[page[s], None] + on_page, 0)], np.int8(-2))
        shared = np.zeros((len(own), len(i) - FINE + 1), bool)
        for k in range(len(j)):
            same = (beside[:, k : k + len(i)] == own) & (abs(j[k]) <= edits[s])[:, None]
            gram = same[:, : len(i) - FINE + 1].copy()
            for f in range(1, FINE):
                gram &= same[:, f : len(i) - FINE + 1 + f]
            shared |= gram
        kind = np.int16 if len(i) < 1 << 15 else np.int32
        total = np.concatenate([np.zeros((len(own), 1), kind), np.cumsum(shared, 1, dtype=kind)], 1)
        ahead = np.minimum(np.arange(total.shape[1])[None] + (window[s] - FINE + 1)[:, None], total.shape[1] - 1)
        keep[s] = (np.take_along_axis(total, ahead, 1) - total).max(1) >= window[s] + 1 - FINE * (edits[s] + 1)
    return keep


def _often(pair: np.ndarray, band: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Which entries may lie in a band of a pair that has as many as needed: counted by hash, so that none is missed."""
    mixed = pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + band.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    slot = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - _BAND_BITS)).astype(np.int64)
    return np.nonzero(np.bincount(slot)[slot] >= need)[0]


def _bands(items: Items, variant: int, stream: np.ndarray, page_of: np.ndarray, begin: np.ndarray, size: np.ndarray) -> list[tuple[int, int, int]]:
    """(page, item, diagonal) of all bands of diagonals with enough shared q-grams."""
    g = grams(stream)
    if not len(g) or not len(items.ids):
        return []
    inner = page_of[: len(g)] == page_of[Q - 1 :]  # no q-gram across two pages
    at = np.nonzero(items.table[variant][slots(g)] & inner)[0]
    keys = items.keys[variant]
    pos = np.searchsorted(keys, g[at])
    hit = keys[np.minimum(pos, len(keys) - 1)] == g[at]
    at, pos = at[hit], pos[hit]
    count = items.first[variant][pos + 1] - items.first[variant][pos]
    if not count.sum():
        return []
    post = np.repeat(items.first[variant][pos] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
    at = np.repeat(at, count)
    item = items.item[variant][post].astype(np.int64)
    place = items.place[variant][post]
    page = page_of[at]
    zero = max(_ZERO, int(place.max()))
    diagonal = at - begin[page] - place + zero
    width, need = 2 * items.edits[variant][item], items.need[variant][item]
    n = len(items.ids)
    pairs = page * n + item
    # a shared q-gram counts once for a place of the item in a band
    regions = []
    for half in (0, 1):  # bands overlap by half ...
        band = (diagonal + half * width // 2) // width
        dense = _often(pairs, band, need)
        pair, band_, place_ = _distinct(pairs[dense], band[dense], place[dense])[0]
        for shift in (0, 1):  # ... and so do the stretches of the item, of two passages
            w = items.window[variant][pair % n]
            stretch = (place_ + shift * w) // (2 * w)
            found, times = _distinct(pair, band_, stretch)
            enough = times >= items.need[variant][found[0] % n]
            p, b, s = (c[enough] for c in found)
            w, wide = items.window[variant][p % n], 2 * items.edits[variant][p % n]
            regions.append(np.column_stack([p // n, p % n, b * wide + wide // 2 - half * wide // 2 - zero, s * (2 * w) - shift * w]))
    seeded = np.unique(np.concatenate(regions), axis=0)
    good = seeded[_refined(items, variant, stream, begin, size, *seeded.T)]
    out: list[tuple[int, int, int]] = []
    for p, i, d, _ in good.tolist():  # in ascending order: bands that nearly coincide are one
        if not out or out[-1][:2] != (p, i) or d - out[-1][2] > items.edits[variant][i]:
            out.append((p, i, d))
    return out


def search(blocks: list[Items], pages: list[tuple[list[str], np.ndarray, np.ndarray, np.ndarray, float | None]]) -> list[tuple[int, object, int]]:
    """(page, id of the item, words) for every item of which a page carries at least WORDS words in a row."""
    best: dict[tuple[int, int, int], int] = {}
    ordered = [reading_order(*p) for p in pages]
    for variant in (0, 1):
        parts, who = [], []
        for k, lines in enumerate(ordered):
            text = "\n".join(lines)
            if variant and not _UNUSUAL.search(text):
                continue
            parts.append(codes(fold(text, variant == 1)))
            who.append(k)
        if not parts:
            continue
        sizes = np.array([len(p) for p in parts])
        begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        stream, page_of = np.concatenate(parts), np.repeat(np.arange(len(parts)), sizes)
        for b, items in enumerate(blocks):
            for page, item, diagonal in _bands(items, variant, stream, page_of, begin, sizes):
                key = (who[page], b, item)
                if best.get(key, 0) >= WORDS:
                    continue
                band = 2 * int(items.edits[variant][item])
                if _touched(parts[page], items.letters[variant][item], items.starts[variant][item], diagonal, band) < WORDS - SLACK:
                    continue
                words = _runs(parts[page].tobytes(), items.letters[variant][item].tobytes(), items.starts[variant][item].tolist(), diagonal, band)
                if words >= WORDS:
                    best[key] = max(best.get(key, 0), words)
    return [(p, blocks[b].ids[i], w) for (p, b, i), w in sorted(best.items())]


def leaked(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", boxes: str = "line_boxes", width: str = "page_width",
           item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item_key, words) of all documents and the items of which they carry a passage.

    Null and empty texts carry nothing; null items, and items under WORDS words, can't be carried.  Texts whose boxes
    are missing or don't match their lines are read in the order of the lines.  Repeated rows are judged each, repeated
    items count once per id; ids may be null.  Documents are read whole, however long.
    """
    spark = documents.sparkSession
    sized = items.where(F.col(item_text).isNotNull()).select(F.col(item_key), F.col(item_text).alias("_text")).distinct()
    letters = sized.agg(F.sum(F.length("_text"))).first()[0] or 0
    blocks = max(1, -(-int(letters) // BLOCK_LETTERS))
    kind, item_kind = (df.schema[c].dataType.simpleString() for df, c in ((documents, key), (items, item_key)))
    pages = documents.where(F.length(text) > 0).select(
        key, text, F.col(width).cast("double").alias("_width"), *[F.col(f"{boxes}.{c}").alias(f"_{c}") for c in ("x0", "y0", "x1")]
    )
    item_type = to_arrow_type(items.schema[item_key].dataType)
    result = None
    for first in range(0, blocks, BLOCKS):
        shared = []
        for block in range(first, min(first + BLOCKS, blocks)):
            # the stated items, a block of bounded size at a time
            own = sized.where(F.pmod(F.xxhash64("_text"), F.lit(blocks)) == block).collect()
            shared.append(spark.sparkContext.broadcast(index_items([(r[0], r[1]) for r in own])))

        def find(batches, shared=shared):
            for batch in batches:
                texts, widths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                sides = []
                for c in (3, 4, 5):
                    column = batch.column(c)
                    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False)).astype(int))))
                    sides.append((flat.astype(float), ends))
                at, which, words = [], [], []
                for a in range(0, len(texts), PAGES):
                    group = []
                    for i in range(a, min(a + PAGES, len(texts))):
                        x0, y0, x1 = (np.nan_to_num(flat[ends[i] : ends[i + 1]]) for flat, ends in sides)
                        group.append((texts[i].split("\n"), x0, y0, x1, widths[i]))
                    for p, item, n in search([b.value for b in shared], group):
                        at.append(a + p)
                        which.append(item)
                        words.append(n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())), pa.array(which, item_type), pa.array(words, pa.int32())], names=[key, "_item", "words"]
                )

        part = pages.mapInArrow(find, f"`{key}` {kind}, _item {item_kind}, words int")
        result = part if result is None else result.unionByName(part)
    return result.groupBy(key, F.col("_item").alias(item_key)).agg(F.max("words").alias("words"))
