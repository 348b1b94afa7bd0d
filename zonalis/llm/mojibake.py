"""Texts garbled by a wrong character encoding: found, and restored where possible.

The unit that is compared is the word, since misread letters leave few lines of two scans equal:

1. words and characters are counted over all documents (per partition first);
2. rare word forms are joined with their clean near-twin - the most frequent form with the same ASCII characters, all
   non-ASCII ones stripped - and both are aligned: the ASCII runs anchor, what lies between them are segment pairs
   (garbled, clean).  A rare form without ASCII letters has as its twin the frequent form that one of the code pages
   turns it into;
3. the transformations that the segment pairs show are learned from them: greedily those of code pages (written in one
   encoding, read in another, once or repeatedly), so that one isn't credited with what a better supported one
   explains, then whatever segments no code page explains as a table of their own (garbled segment to clean segment);
4. every distinct word form is judged once by the learned transformations.  A restoration counts if its word is a known
   one and much more frequent than the garbled form, if the garbled form is a well-formed multi-byte sequence, or if its
   characters can't stand where they do;
5. the judged forms are looked up in all documents: by a broadcast up to VERDICTS forms, by a salted join beyond that.

Any script may be restored.  Letters of other scripts than Latin must make up the segment they stand in, all of one
script, at least two of them for a multi-byte sequence and three otherwise.  Characters that were lost (the replacement
character) mark a text as garbled, but can't be restored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.plans.runtime import checkpointed, keyed_join

LOST = "�"
#: Code pages that may explain segment pairs (fixed values); unassigned bytes are read as control characters.
CODE_PAGES = (
    "cp437", "cp737", "cp775", "cp850", "cp852", "cp855", "cp857", "cp858", "cp860", "cp861", "cp862", "cp863", "cp865", "cp866", "cp869", "cp1250", "cp1251", "cp1252",
    "cp1253", "cp1254", "cp1255", "cp1256", "cp1257", "cp1258", "iso8859_2", "iso8859_3", "iso8859_4", "iso8859_5", "iso8859_6", "iso8859_7", "iso8859_8", "iso8859_9",
    "iso8859_10", "iso8859_13", "iso8859_14", "iso8859_15", "iso8859_16", "koi8_r", "koi8_u", "mac_cyrillic", "mac_greek", "mac_iceland", "mac_latin2", "mac_roman", "mac_turkish",
)
#: Of these the usual ones to be read in and written in: they come first where several explain the same, and they alone
#: may have turned a letter into another Latin letter, which misreading does as well.
READ = ("cp1252", "mac_roman", "cp437", "cp850", "cp1251", "cp1253", "cp1250")
WRITTEN = ("utf-8", "cp1252", "mac_roman", "cp437", "cp850")
#: Characters that break words at line ends; quotes, which may touch words; other typographic characters.
BREAKS = "­¬‐"
QUOTES = "“”‘’«»¡¿"
TYPOGRAPHY = frozenset(QUOTES + "—–…ºª°€£§•")
EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" + QUOTES + "—–…"
#: Share of the documents in which a character of a restored word must occur, and up to which one counts as rare.
COMMON, RARE, ODD = 0.002, 0.02, 0.01
#: A known word occurs so often at least, and so many times as often as the garbled form.
KNOWN, TIMES = 3, 5
#: Words of different skeletons that must support a transformation.
SUPPORT = 3
#: Share of a garbled segment's twins that must agree on the clean one, where no code page explains it.
AGREE = 0.8
#: Distinct words that are kept in a task before they are handed on.
KEPT = 200_000
#: Judged word forms that are broadcast.
VERDICTS = 200_000
#: The transformation that is a table of segments.
TABLE = ("table", "table")
_ASCII = re.compile(r"([\x00-\x7f]+)")


def _upper_half(encoding: str) -> list[str]:
    out = []
    for b in range(128, 256):
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


_DECODE = {e: _upper_half(e) for e in CODE_PAGES}
_ENCODE = {e: {ch: 128 + i for i, ch in enumerate(half)} for e, half in _DECODE.items()}
for _b in range(128, 160):  # as texts read in Latin-1 have them
    _ENCODE["cp1252"].setdefault(chr(_b), _b)


def undo(word: str, read: str, written: str) -> str | None:
    """`word`, read in `read`, as it was written in `written`; None where its characters don't come from there."""
    codes, out = _ENCODE[read], bytearray()
    for ch in word:
        b = ord(ch) if ch < "\x80" else codes.get(ch)
        if b is None:
            return None
        out.append(b)
    if written == "utf-8":
        try:
            return out.decode("utf-8")
        except UnicodeDecodeError:
            return None
    half = _DECODE[written]
    return "".join(chr(b) if b < 128 else half[b - 128] for b in out)


def undone(word: str, read: str, written: str) -> str | None:
    """As undo(), repeated while a multi-byte reading still applies; None if nothing changes."""
    out = undo(word, read, written)
    if written == "utf-8":
        for _ in range(2):
            more = undo(out, read, written) if out else None
            if more is None or more == out:
                break
            out = more
    return out if out != word else None


USUAL = tuple((r, w) for r in READ for w in WRITTEN if r != w)
PAIRS = USUAL + tuple((r, w) for r in CODE_PAGES for w in ("utf-8", *CODE_PAGES) if r != w and (r, w) not in set(USUAL))
_NUMBER = {p: k for k, p in enumerate(PAIRS)}


@lru_cache(maxsize=100_000)
def script(ch: str) -> str:
    """LATIN, CYRILLIC, GREEK, CJK ...; empty for what is no letter."""
    return unicodedata.name(ch, "?").split(" ")[0].split("-")[0] if ch.isalpha() else ""


def _bytes(text: str, encoding: str) -> bytes | None:
    codes = _ENCODE[encoding]
    try:
        return bytes(codes[ch] for ch in text)
    except KeyError:
        return None


@lru_cache(maxsize=100_000)
def explained_by(garbled: str, clean: str) -> frozenset[int]:
    """Numbers of the PAIRS that turn a garbled segment, of no ASCII characters, into the clean one."""
    out, as_read = set(), {}
    for r in CODE_PAGES:
        b = _bytes(garbled, r)
        if b is not None:
            as_read.setdefault(b, []).append(r)
            if undone(garbled, r, "utf-8") == clean:
                out.add(_NUMBER[r, "utf-8"])
    for w in CODE_PAGES:
        b = _bytes(clean, w)
        out |= {_NUMBER[r, w] for r in as_read.get(b, ()) if r != w}
    latin = any(script(ch) == "LATIN" for ch in garbled)
    return frozenset(k for k in out if k < len(USUAL) or not latin or PAIRS[k][1] == "utf-8")


def core(word: str) -> str:
    return word.strip(EDGE).lower()


def segments(garbled: str, clean: str) -> list[tuple[str, str, str, str]] | None:
    """(garbled, clean, character before, character after) of all differing segments between the common ASCII runs."""
    a, b = _ASCII.split(garbled), _ASCII.split(clean)
    if len(a) != len(b) or a[1::2] != b[1::2]:
        return None
    return [(a[i], b[i], a[i - 1][-1:] if i else "", a[i + 1][:1] if i + 1 < len(a) else "") for i in range(0, len(a), 2) if a[i] != b[i]]


@dataclass(frozen=True)
class Learned:
    """What the corpus taught: the share of documents that hold a character, the transformations by support, and the
    segments that no code page explains."""

    share: dict[str, float]
    pairs: tuple[tuple[str, str], ...]
    table: dict[str, str]

    def undone(self, word: str, read: str, written: str) -> str | None:
        if (read, written) != TABLE:
            return undone(word, read, written)
        parts = _ASCII.split(word)
        # a segment as a whole, or else its characters one by one
        out = [x if k % 2 or not x else self.table.get(x) or "".join(self.table.get(ch, "") or "\0" for ch in x) for k, x in enumerate(parts)]
        restored = "".join(out)
        return restored if restored != word and "\0" not in restored else None

    def fits(self, word: str, restored: str, written: str) -> list[tuple[str, str, str, str]] | None:
        """The segments, if every restored character may stand in its place: a common letter of the case around it,
        a quote beside a letter, other typographic characters apart from letters; letters of other scripts by themselves."""
        found = segments(word, restored)
        if not found:
            return None
        wide = [ch for _, clean, _, _ in found for ch in clean if ch >= "ɐ" and ch.isalpha()]
        if wide:
            return found if self._other_script(found, wide, written) else None
        if any(self.share.get(ch, 0.0) < COMMON for ch in restored if ch > "\x7f"):
            return None
        letters = [ch for ch in word if ch.isascii() and ch.isalpha()]
        capitals = len(letters) > 1 and all(ch.isupper() for ch in letters)
        for garbled, clean, before, after in found:
            beside = before.isalpha() or after.isalpha()
            for ch in clean:
                if ch < "\xa0":
                    return None
                if ch.isalpha():
                    if ch not in "ºª" and ((capitals and ch.islower()) or (before.islower() and after.islower() and ch.isupper())):
                        return None
                elif ch not in TYPOGRAPHY or (beside and ch not in QUOTES + "—–…"):
                    return None
            if written != "utf-8":
                if any(ch in BREAKS for ch in garbled) or not beside:
                    return None
                if not all(ch.isalpha() for ch in clean) and (
                    any(ch.isalpha() and self.share.get(ch, 0.0) > ODD for ch in garbled) or (len(garbled) == 1 and garbled in TYPOGRAPHY)
                ):
                    return None
        return found

    def _other_script(self, found: list[tuple[str, str, str, str]], wide: list[str], written: str) -> bool:
        """Whether the changed segments are words, or parts of words, of one script other than Latin."""
        if len({script(ch) for ch in wide}) > 1 or len(wide) < (2 if written == "utf-8" else 3):
            return False
        if any(before.isalpha() or after.isalpha() for _, clean, before, after in found if any(ch in wide for ch in clean)):
            return False
        if any(ch not in wide and ch not in TYPOGRAPHY for _, clean, _, _ in found for ch in clean):
            return False
        return written == "utf-8" or all(self.share.get(ch, 0.0) >= COMMON for ch in wide)

    def readings(self, word: str) -> list[tuple[str, bool, bool, bool]]:
        """(restored, likelier, sure, page) for each learned transformation that applies to a word; `page` tells those of
        code pages, which keep what a table may change: small letters and capitals."""
        out: dict[str, tuple[str, bool, bool, bool]] = {}
        for read, written in self.pairs:
            restored = self.undone(word, read, written)
            found = self.fits(word, restored, written) if restored else None
            if not found:
                continue
            gain = sum(math.log(self.share.get(ch, 1e-9)) for _, c, _, _ in found for ch in c) - sum(math.log(self.share.get(ch, 1e-9)) for g, _, _, _ in found for ch in g)
            sure = written == "utf-8" or (
                len(core(restored)) >= 3
                and all(len(g) == len(c) and all(self._misplaced(x, before, after) and self.share.get(y, 0.0) >= 5 * self.share.get(x, 0.0) for x, y in zip(g, c)) for g, c, before, after in found)
            )
            old = out.get(restored, (restored, False, False, False))
            out[restored] = (restored, old[1] or gain > 0, old[2] or sure, old[3] or (read, written) != TABLE)
        return list(out.values())

    def _misplaced(self, ch: str, before: str, after: str) -> bool:
        """A rare character that no Latin word has in that place."""
        if self.share.get(ch, 0.0) > RARE:
            return False
        return not ch.isalpha() or ch >= "ɐ" or (ch.isupper() and before.islower())


def words_of(text: str) -> set[str]:
    return set(text.replace("\n", " ").split(" "))


def _count(batches):
    """(kind, key, n): documents by word (w), by form of a word with non-ASCII characters (f), by character (c), and by
    such words as they stand, where their form is another (r)."""
    counts: dict[str, Counter] = {"w": Counter(), "f": Counter(), "c": Counter(), "r": Counter()}
    cores: dict[str, str] = {}

    def rows():
        for kind, c in counts.items():
            keys = list(c)
            for a in range(0, len(keys), 10_000):
                part = keys[a : a + 10_000]
                yield pa.RecordBatch.from_pydict({"kind": [kind] * len(part), "key": part, "n": pa.array([c[k] for k in part], pa.int64())})
            c.clear()
        cores.clear()

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if not text:
                continue
            found = words_of(text)
            for w in found:
                if w not in cores:
                    cores[w] = core(w)
            counts["w"].update({cores[w] for w in found})
            if not text.isascii():
                forms = {w: w.strip(EDGE) for w in found if not w.isascii()}
                counts["f"].update(set(forms.values()))
                counts["r"].update(w for w, f in forms.items() if w != f)
                counts["c"].update({ch for w in forms for ch in w if ch > "\x7f"})
        if len(cores) > KEPT:
            yield from rows()
    yield from rows()


_EXPLAINED = "form string, clean string, skeleton string, pairs array<int>, segments array<struct<garbled:string,clean:string>>"


def _explain(share: dict[str, float]):
    """Arrow function: (form, clean, skeleton) with the transformations that explain all of the form, and the segment
    pairs that misreading can't explain: symbols or letters of another script for much more common Latin letters."""

    def odd(ch: str) -> bool:
        return script(ch) != "LATIN" and ch != LOST and ch not in BREAKS and ch not in TYPOGRAPHY

    def rarer(garbled: str, clean: str) -> bool:
        least = min(share.get(ch, 0.0) for ch in clean)
        return least >= COMMON and all(odd(ch) and share.get(ch, 0.0) * TIMES <= least for ch in garbled)

    def run(batches):
        for batch in batches:
            rows: dict[str, list] = {"pairs": [], "segments": []}
            for form, clean in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = segments(form, clean) or []
                by = frozenset.intersection(*(explained_by(g, c) for g, c, _, _ in found)) if found and all(g and c for g, c, _, _ in found) else frozenset()
                rows["pairs"].append(sorted(by))
                rows["segments"].append([
                    {"garbled": g, "clean": c} for g, c, before, after in found
                    if g and c and (before.isalpha() or after.isalpha()) and all(script(ch) == "LATIN" for ch in c) and rarer(g, c)
                ])
            kinds = pa.list_(pa.int32()), pa.list_(pa.struct([("garbled", pa.string()), ("clean", pa.string())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, k) for v, k in zip(rows.values(), kinds))], names=["form", "clean", "skeleton", *rows])

    return run


def _alone(share: dict[str, float]):
    """Arrow function: (form, clean, n, pair, sure) of what code pages make of forms without ASCII letters, if it is a
    word of one other script; a multi-byte sequence of three such letters needs no twin."""
    own = {ch for ch, s in share.items() if s >= COMMON and ch.isalpha() and script(ch) != "LATIN"}
    single = [w for w in CODE_PAGES if own & set(_DECODE[w])]
    learned = Learned(share, (), {})

    def run(batches):
        for batch in batches:
            rows: dict[str, list] = {c: [] for c in ("form", "clean", "n", "pair", "sure")}
            for form, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for read in CODE_PAGES:
                    if _bytes("".join(_ASCII.split(form)[::2]), read) is None:
                        continue
                    for written in ("utf-8", *single):
                        restored = undone(form, read, written) if read != written else None
                        found = restored and learned.fits(form, restored, written)
                        wide = sum(ch >= "ɐ" and ch.isalpha() for ch in restored) if found else 0
                        if wide:
                            for c, v in zip(rows, (form, restored, n, _NUMBER[read, written], written == "utf-8" and wide >= 3)):
                                rows[c].append(v)
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds)], names=list(rows))

    return run


def _greedy(counted: list[tuple[list[int], int]]) -> list[int]:
    """The transformation with the most words, then the one with the most of the words it doesn't explain, and so on;
    `counted` has the words by the set of transformations that explain them."""
    pairs: list[int] = []
    while True:
        support = Counter()
        for by, n in counted:
            if not set(by) & set(pairs):
                support.update(dict.fromkeys(by, n))
        best = min(support, key=lambda k: (-support[k], k), default=None)
        if best is None or support[best] < SUPPORT:
            return pairs
        pairs.append(best)


def learn(documents: DataFrame, text: str) -> tuple[Learned, DataFrame, DataFrame]:
    """What the texts teach, the counts of their words (word, n), and their distinct words with other characters (form)."""
    counted = checkpointed(documents.select(text).mapInArrow(_count, "kind string, key string, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    n = max(1, documents.count())
    # one row per character that occurs: bounded by the character set
    share = {r["key"]: r["n"] / n for r in counted.where("kind = 'c'").collect()}
    words = counted.where("kind = 'w'").select(F.col("key").alias("word"), "n")
    every = counted.where("kind = 'f'").select(F.col("key").alias("form"), "n", F.regexp_replace("key", r"[^\x00-\x7F]+", "").alias("skeleton"))
    forms = every.where(F.length("skeleton") >= 3)
    twins = forms.groupBy("skeleton").agg(F.max_by("form", F.struct("n", "form")).alias("clean"), F.max("n").alias("most")).where(F.col("most") >= KNOWN)
    near = forms.join(twins, "skeleton").where((F.col("form") != F.col("clean")) & (F.col("n") * TIMES <= F.col("most")))
    explained = near.select("form", "clean", "skeleton").mapInArrow(_explain(share), _EXPLAINED)
    guessed = checkpointed(every.where(F.length("skeleton") < 3).select("form", "n").mapInArrow(_alone(share), "form string, clean string, n bigint, pair int, sure boolean"))
    known = every.where(F.col("n") >= KNOWN).select(F.col("form").alias("clean"), F.col("n").alias("most"))
    backed = guessed.join(known, "clean", "left").where(F.col("sure") | (F.col("n") * TIMES <= F.col("most")))
    backed = backed.groupBy("form").agg(F.max("clean").alias("clean"), F.array_sort(F.collect_set("pair")).alias("pairs"))  # bounded by the code pages
    empty = F.array().cast("array<struct<garbled:string,clean:string>>").alias("segments")
    explained = checkpointed(explained.unionByName(backed.select("form", "clean", F.col("clean").alias("skeleton"), "pairs", empty)))
    # one row for every set of code pages that explain the same
    sets = explained.where(F.size("pairs") > 0).groupBy("pairs").agg(F.count_distinct("skeleton").alias("n")).collect()
    chosen = _greedy([(r["pairs"], r["n"]) for r in sets])
    left = explained.where(~F.arrays_overlap("pairs", F.array(*map(F.lit, chosen)).cast("array<int>")) if chosen else F.lit(True))
    seen = left.select("skeleton", F.explode("segments").alias("s")).select("skeleton", "s.garbled", "s.clean").groupBy("garbled", "clean").agg(F.count_distinct("skeleton").alias("n"))
    best = seen.groupBy("garbled").agg(F.max_by("clean", F.struct("n", "clean")).alias("clean"), F.max("n").alias("n"), F.sum("n").alias("all"))
    # short sequences of rare characters, each between the letters of several words
    table = {r["garbled"]: r["clean"] for r in best.where((F.col("n") >= SUPPORT) & (F.col("n") >= AGREE * F.col("all"))).collect()}
    pairs = tuple(PAIRS[k] for k in chosen) + ((TABLE,) if table else ())
    return Learned(share, pairs, table), words, counted.where("kind in ('f', 'r')").select(F.col("key").alias("form")).distinct()


def verdicts(documents: DataFrame, text: str) -> DataFrame:
    """(form, restored): the garbled words among all, judged once each, and what they were, null where lost.  Checkpointed."""
    learned, words, forms = learn(documents, text)
    shared = documents.sparkSession.sparkContext.broadcast(learned)

    def read(batches):
        for batch in batches:
            rows: dict[str, list] = {c: [] for c in ("form", "restored", "likelier", "sure", "page", "core_form", "core_restored")}
            for w in batch.column(0).to_pylist():
                for restored, likelier, sure, page in [(None, True, True, True)] if LOST in w else shared.value.readings(w):
                    for c, v in zip(rows, (w, restored, likelier, sure, page, core(w), core(restored) if restored else None)):
                        rows[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.bool_() if c in ("likelier", "sure", "page") else pa.string()) for c, v in rows.items()], names=list(rows))

    found = checkpointed(forms.mapInArrow(read, "form string, restored string, likelier boolean, sure boolean, page boolean, core_form string, core_restored string"))
    asked = found.select(F.col("core_form").alias("word")).union(found.select("core_restored")).distinct()
    counts = words.join(asked, "word", "left_semi")
    of = lambda c: counts.select(F.col("word").alias(c), F.col("n").alias(f"n_{c}"))
    judged = found.join(of("core_form"), "core_form", "left").join(of("core_restored"), "core_restored", "left")
    seen, was = F.coalesce("n_core_restored", F.lit(0)), F.coalesce("n_core_form", F.lit(0))
    known_word = F.col("likelier") & (F.col("core_restored") != "") & (F.col("core_restored") != F.col("core_form")) & (seen >= KNOWN) & (seen >= TIMES * was)
    good = judged.where(F.col("restored").isNull() | F.col("sure") | known_word)
    best = good.groupBy("form").agg(F.max(F.struct(F.coalesce(known_word, F.lit(False)).alias("k"), seen.alias("s"), "page", "restored")).alias("_b"))
    return checkpointed(best.select("form", F.col("_b.restored").alias("restored")))


def _own_words(key: str, judged: dict[str, str | None] | None):
    """Arrow function: (key, form[, restored]) of the distinct words of every document with other characters, or of those
    that are judged garbled."""

    def run(batches):
        for batch in batches:
            at, forms = [], []
            for i, body in enumerate(batch.column(1).to_pylist()):
                if body and not body.isascii():
                    mine = [w for w in words_of(body) if (not w.isascii() if judged is None else w in judged)]
                    at += [i] * len(mine)
                    forms += mine
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(forms, pa.string())]
            if judged is not None:
                columns.append(pa.array([judged[w] for w in forms], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[key, "form", "restored"][: len(columns)])

    return run


def evidence(documents: DataFrame, key: str, text: str, broadcast: int = VERDICTS) -> DataFrame:
    """(key, form, restored, lost): the garbled words of every document and what they were, null where lost; up to
    `broadcast` forms are looked up without a shuffle."""
    judged = verdicts(documents, text)
    kind = f"`{key}` {documents.schema[key].dataType.simpleString()}, form string"
    n = judged.count()
    if n <= broadcast:
        shared = documents.sparkSession.sparkContext.broadcast({r["form"]: r["restored"] for r in judged.collect()})
        found = documents.select(key, text).mapInArrow(lambda batches: _own_words(key, shared.value)(batches), kind + ", restored string")
    else:
        found = keyed_join(documents.select(key, text).mapInArrow(_own_words(key, None), kind), judged, "form", n, limit=broadcast).select(key, "form", "restored")
    return found.select(key, "form", "restored", F.col("form").contains(LOST).alias("lost"))


def garbled(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key) of the documents with garbled words.

    Null and empty texts are clean; documents with equal text are judged alike; null keys are keys like others.  An
    empty table gives an empty result, and so does one too small to teach any transformation, but for lost characters.
    """
    return evidence(documents, key, text).select(key).distinct()


def restored(documents: DataFrame, key: str, text: str, broadcast: int = VERDICTS) -> DataFrame:
    """(key, restored_text, n_words, n_lost) of the garbled documents: the text with its garbled words replaced, how
    many different words that were and how many of them hold lost characters, which stay."""
    judged = verdicts(documents, text)
    n = judged.count()
    kind = documents.schema[key].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast({r["form"]: r["restored"] for r in judged.collect()}) if n <= broadcast else None

    def replace(batches):
        for batch in batches:
            at, out, n_words, n_lost = [], [], [], []
            own = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
            for i, (body, words) in enumerate(zip(batch.column(1).to_pylist(), own)):
                if not body or body.isascii():
                    continue
                to = shared.value if words is None else dict(words)
                mine = {w for w in words_of(body) if w in to}
                if mine:
                    at.append(i)
                    out.append("\n".join(" ".join(to.get(w) or w for w in line.split(" ")) for line in body.split("\n")))
                    n_words.append(len(mine))
                    n_lost.append(sum(LOST in w for w in mine))
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(out, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_lost, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "restored_text", "n_words", "n_lost"])

    texts = documents.select(key, text)
    if shared is None:
        found = keyed_join(texts.mapInArrow(_own_words(key, None), f"`{key}` {kind}, form string"), judged, "form", n, limit=broadcast)
        per = found.groupBy(F.col(key).alias("_key")).agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("form", "restored")))).alias("_words"))  # bounded by one text
        texts = texts.join(per, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    return texts.mapInArrow(replace, f"`{key}` {kind}, restored_text string, n_words bigint, n_lost bigint")
