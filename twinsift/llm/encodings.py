"""Problem 8: text that was decoded with another encoding than it was written in."""

from __future__ import annotations

import hashlib
import math
import pickle
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache, reduce
from operator import or_

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import Workspace
from .tokens import spread

#: Encodings that text may have been read with, and those it may have been written in.
READ_AS = ("cp1252", "latin_1", "cp437", "cp850", "cp852", "mac_roman", "cp1250", "iso8859_2", "iso8859_15", "cp1251", "koi8_r", "cp866", "mac_cyrillic", "gb18030", "cp932", "big5", "euc_kr", "euc_jp")
WRITTEN_IN = ("utf_8", "cp1252", "cp1250", "iso8859_2", "cp1251", "koi8_r", "cp866", "mac_cyrillic", "iso8859_5", "mac_roman", "cp850", "cp852", "cp437", "cp932", "euc_jp")
#: Those of the former whose characters take several bytes.
SEVERAL_BYTES = ("gb18030", "cp932", "big5", "euc_kr", "euc_jp")
#: A text may have been read wrongly this many times in a row.
MOST_STEPS = 3
#: Description lengths count bytes. Naming a step of a chain among all possible ones costs this much:
STEP_COST = math.log2(len(READ_AS) * len(WRITTEN_IN)) / 8
#: A violation (see ``violations``) costs this many bytes, in a sentence as it stands and in every candidate alike.
VIOLATION_COST = 2.0
#: An odd pair of neighbours, one that no text of the sample has, costs this many, again in all alike.
ODD_COST = 1.5
#: Saying that a sentence is garbled at all; and what the sentences of one chain must save together beyond all that.
SWITCH_COST, MARGIN = 1.5, 0.5
#: Of the words that a chain changes at least this share must lose violations or become words of the sample.
LEAST_EVIDENCE = 0.25
#: A candidate that misses by no more than this is measured with all languages.
CLOSE = 4.0
#: So many chains of a sentence are remembered for the choice between the chains of its text.
MOST_CHAINS = 8
#: In counts, the texts of a language together weigh as much as so many at most, so that no language outvotes others.
LANGUAGE_WEIGHT = 400
#: Something is usual if texts of at least this weight have it: ASCII runs, words, pairs of neighbours.
USUAL = {"run": 3, "word": 2, "pair": 2}
DICTIONARY_BYTES = 65_536
#: Texts to train on stand for themselves up to so many bytes of a language and part; more are first condensed to a dictionary.
UNCONDENSED_BYTES = 2_000_000
#: So many parts of the texts to train on are merged at once.
MERGED_PARTS = 16
#: What a worker has found out about a word is kept for the next time, if the word is no longer than this.
REMEMBERED_CHARS = 64
LEVEL = 3
#: What a failed decode leaves behind: such a character is lost, so it is evidence but can't be restored.
LOST = "�"

_SENTENCES = re.compile(r"[^\n.!?。！？]*[^\x00-\x7f\n.!?。！？][^\n.!?。！？]*(?:[.!?。！？]+|\n|$)?")
#: Words end at spaces and at full-width punctuation, which survives where the text around it doesn't.
_PARTS = re.compile(r"([ 。、「」]+)")
_FOREIGN = re.compile(r"[^\x00-\x7f]+")
_ASCII_RUNS = re.compile(r"[\x21-\x7e]+")
_DIGITS = re.compile(r"[0-9]+")
_LETTERS = re.compile(r"[^\W\d_]{3,}|[\u3040-\u9fff]{2,}")
_JOINED = re.compile(r"[^\W\d_\u2e80-\uffff]{2,}")
_AS_ASCII = re.compile("[¥‾]")
_ALONE = re.compile(r"(?<![^\W\d_])[^\W\d_\x00-\x7f]{2,}(?![^\W\d_])")
#: A lost character between quotes or brackets is talked about, not lost; so is a word of foreign signs alone.
_MENTION = re.compile(r"""(?<=["'(\[`“„«‘])[^\x00-\x7f]{1,4}(?=["')\]`”“»’])""")


class _Kinds(dict):
    """Code points -> one letter for what a character is, by its Unicode properties alone.

    a A l U: Latin letters (ASCII lower and upper, others lower and upper); c C: Cyrillic; g G: Greek; h: Han; o: other
    letters; w: half-width katakana; 0: digits; b r j v: box drawing with arms on both sides, right, left, neither;
    m: signs that may end a word; s: other signs; e: currencies; p: daggers and per mille; q: dashes, apostrophes and dots
    that may stand inside words; Q: quotes; i: inverted marks; n: no-break blanks; d: arrows and ornaments; x: controls
    and unassigned code points; z: a lost character; M: combining marks; a dot or a blank: the rest of ASCII.
    """

    def __missing__(self, code: int) -> str:
        k = self[code] = self._kind(chr(code))
        return k

    @staticmethod
    def _kind(c: str) -> str:
        if c <= "\x7f":
            return "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else " " if c.isspace() else "."
        cat, name = unicodedata.category(c), unicodedata.name(c, "")
        if c == LOST:
            return "z"
        if cat in ("Cc", "Co", "Cn", "Cs"):
            return "x"
        if cat == "Zs":
            return "n"
        if "\u2500" <= c <= "\u257f":
            arms = [w in name for w in ("LEFT", "RIGHT")]
            left, right = (True, True) if "HORIZONTAL" in name else arms
            return "b" if left and right else "r" if right else "j" if left else "v"
        if "\uff61" <= c <= "\uff9f":
            return "w"
        if cat[0] == "M":
            return "M"
        if c in "ªºµ®™°" or cat == "No" and "FRACTION" not in name:
            return "m"
        if cat[0] == "L":
            if "SUPERSCRIPT" in name or "SUBSCRIPT" in name:
                return "s"
            if name.startswith("CJK"):
                return "h"
            pair = {"LATIN": "lU", "CYRIL": "cC", "GREEK": "gG"}.get(name[:5])
            return pair[c.isupper()] if pair else "o"
        if cat == "Sc":
            return "e"
        if c in "‰†‡":
            return "p"
        if c in "¿¡":
            return "i"
        if cat == "Cf" or c in "’‘ʼ′…·•‐‑‒–—―" or "\u3000" <= c <= "\u30ff" or c >= "\uff00":
            return "q"
        if cat in ("Pi", "Pf", "Ps", "Pe"):
            return "Q"
        if cat[0] == "S" and (c >= "\u2580" and c not in "░▒▓█▄▌▐▀■" or "\u2190" <= c <= "\u21ff"):
            return "d"
        return "s"


_KINDS = _Kinds()
#: What sound writing of any language hardly has, in terms of ``_Kinds``.
_VIOLATION = re.compile(
    b"(?="
    b"[aAlU][cCgG]|[cCgG][aAlU]|[cC][gG]|[gG][cC]"  # two alphabets in a word
    b"|[al]U|l[AU]|cC|gG"  # a capital after a small letter
    b"|[aAlUcCgG][smepQirjb]+[aAlUcCgG]"  # signs between letters
    b"|(?<![aAlUcCgG0smep])s[alUcCgG]"  # a sign that begins a word
    b"|[aAlUcCgG]s(?![aAlUcCgG])|[aAlU]i(?![aAlUcCgG])|[lUcCgG]e|Up"  # one that ends it
    b"|(?<![aAlUcCgG0.])[UC][nsmQepq](?![aAlUcCgG])"  # a lone capital before a sign
    b"|[lU]{3}"  # a third letter with a mark in a row
    b"|x|[aAlU]w|w[aAlU]|[aAlU]h{1,2}[al]"  # no characters at all; East Asian ones inside Latin words
    b"|[br][rv]|[jv][bj]|[aAlUcCgG][brj]|[rj][aAlUcCgG]"  # boxes whose lines don't meet
    b")"
)


def violations(text: str) -> int:
    """How many places of a text offend against what sound writing of any language has.

    Known beforehand and the same for every sample: alphabets don't mix inside words, capitals don't follow small letters,
    signs don't stand between letters, the lines of boxes meet. Wrong readings make such places nearly always, however
    frequent the reading is; sound texts of languages that no dictionary knows have hardly any.
    """
    return sum(map(_offences, _foreign_words(text)))


def _foreign_words(text: str) -> list[str]:
    """What stands between blanks, line ends and tabs and holds a character outside ASCII.

    All that is looked for in a text lies in a run of such characters and its two neighbours, and blanks there count like
    the ends of the text; so words, of which texts repeat most, tell the same as the text.
    """
    return [w for w in _split(text) if not w.isascii()]


def _split(text: str) -> list[str]:
    return text.replace("\n", " ").replace("\t", " ").split(" ")


def _offences(word: str) -> int:
    return _short_offences(word) if len(word) <= REMEMBERED_CHARS else sum(map(_violations, _keys(word)))


@lru_cache(maxsize=50_000)
def _short_offences(word: str) -> int:
    return sum(map(_violations, _keys(word)))


def _keys(text: str) -> list[str]:
    """The runs of characters outside ASCII, each with the character before and after it."""
    return [text[a - 1 if a else 0 : b + 1] for a, b in map(re.Match.span, _FOREIGN.finditer(text))]


@lru_cache(maxsize=50_000)
def _violations(key: str) -> int:
    return _violations_of(key.translate(_KINDS).encode())


@lru_cache(maxsize=50_000)
def _violations_of(kinds: bytes) -> int:
    return len(_VIOLATION.findall(kinds))


def encode(text: str, name: str) -> bytes:
    """``text.encode`` with the holes of a table filled by the control characters of the same value, as lenient decoders do."""
    if LOST in text:
        raise UnicodeError("lost characters have no bytes")
    if name in SEVERAL_BYTES and _AS_ASCII.search(text):
        raise UnicodeError("such a character would have been read from an ASCII byte")
    try:
        return text.encode(name)
    except UnicodeEncodeError:
        if name not in ("cp1252", "cp1250", "cp1251"):
            raise
        return b"".join(bytes([ord(c)]) if 0x80 <= ord(c) <= 0x9F else c.encode(name) for c in text)


def undo(text: str, read_as: str, written_in: str) -> str | None:
    """``text`` as if it had been read right, or None if it can't have come about this way."""
    try:
        return encode(text, read_as).decode(written_in)
    except (UnicodeError, ValueError):
        return None


def _table(name: str) -> list[str]:
    """The characters of the bytes of an encoding of one byte a character; "" where it has a hole."""
    return [bytes([b]).decode(name, "ignore") for b in range(256)]


_ONE_BYTE = [x for x in dict.fromkeys(READ_AS + WRITTEN_IN) if x != "utf_8" and x not in SEVERAL_BYTES]
#: All characters that ``encode`` has bytes for.
_ENCODABLE = {x: frozenset("".join(_table(x))) | (frozenset(map(chr, range(0x80, 0xA0))) if x in ("cp1252", "cp1250", "cp1251") else frozenset()) for x in _ONE_BYTE}
#: Bytes -> kinds of their characters, "?" for holes.
_KINDS_OF_BYTES = {x: "".join(_KINDS[ord(c)] if c else "?" for c in _table(x)).encode() for x in _ONE_BYTE}


def _readings(word: str, most: int) -> dict[str, tuple[int, list[tuple[str, str]]]]:
    """What undoing one reading makes of a word without more than ``most`` violations: result -> (violations, its steps)."""
    found: dict[str, tuple[int, list[tuple[str, str]]]] = {}
    decoded: dict[bytes, list[tuple[str, str, int]]] = {}
    chars = set(word)
    for r in READ_AS:
        if r in _ENCODABLE and not _ENCODABLE[r].issuperset(chars):
            continue
        try:
            raw = encode(word, r)
        except (UnicodeError, ValueError):
            continue
        if raw not in decoded:
            decoded[raw] = list(_decoded(raw, most))
        for w, t, n in decoded[raw]:
            if w != r:
                found.setdefault(t, (n, []))[1].append((r, w))
    found.pop(word, None)
    return found


def _decoded(raw: bytes, most: int) -> Iterator[tuple[str, str, int]]:
    """(encoding, text, its violations) of bytes, where there are no more than ``most``."""
    for w in WRITTEN_IN:
        if w in _KINDS_OF_BYTES:
            kinds = raw.translate(_KINDS_OF_BYTES[w])
            if b"?" not in kinds and (n := _violations_of(kinds)) <= most:
                yield w, raw.decode(w), n
        else:
            try:
                t = raw.decode(w)
            except (UnicodeError, ValueError):
                continue
            if (n := _violations_of(t.translate(_KINDS).encode())) <= most:
                yield w, t, n


_ASCII_PAIRS = frozenset(chr(a) + chr(b) for a in range(128) for b in range(128))


class _Recoding(dict):
    """Characters of a language as one byte (the frequent ones) or two; all others as an escape and their UTF-8 bytes.

    So every character of the language weighs the same in every candidate, whatever its place in Unicode, and characters
    that the language doesn't use are expensive.
    """

    def __init__(self, alphabet: list[str]):
        super().__init__({i: chr(i) for i in range(128)})
        self.word = lru_cache(maxsize=10_000)(lambda w: w.translate(self))
        for k, c in enumerate(alphabet[: 96 + 31 * 256]):
            self[ord(c)] = chr(0x80 + k) if k < 96 else chr(0xE0 + (k - 96) // 256) + chr((k - 96) % 256)

    def __missing__(self, code: int) -> str:
        c = self[code] = "\xff" + chr(code).encode("utf-8", "surrogatepass").decode("latin-1")
        return c

    def encoded(self, text: str) -> bytes:
        """A text in this alphabet. ASCII stays as it is, so only the words with other characters are looked up."""
        return " ".join([w if w.isascii() else self.word(w) if len(w) <= REMEMBERED_CHARS else w.translate(self) for w in text.split(" ")]).encode("latin-1")


class Speller:
    """Description lengths of pieces of text, by one zstandard dictionary per language."""

    def __init__(self, samples: dict[str, list[str]]):
        self.alphabets = {k: _alphabet(v) for k, v in samples.items()}
        self.lexicon, self.words, self.pairs = _usual(samples)
        self.raw = {k: _dictionary([t.translate(_Recoding(self.alphabets[k])).encode("latin-1") for t in v]) for k, v in samples.items()}
        self.__setstate__(self.__getstate__())

    @classmethod
    def of(cls, alphabets: dict[str, list[str]], lexicon: frozenset[str], words: frozenset[str], pairs: frozenset[str], raw: dict[str, tuple[bytes, bool]]) -> Speller:
        """A speller from counts and dictionaries that were made elsewhere."""
        s = cls.__new__(cls)
        s.__setstate__({"alphabets": alphabets, "lexicon": lexicon, "words": words, "pairs": pairs, "raw": raw})
        return s

    def with_languages_of(self, other: Speller) -> Speller:
        """This speller with the alphabets and dictionaries of the languages that only the other one knows."""
        return Speller.of({**other.alphabets, **self.alphabets}, self.lexicon, self.words, self.pairs, {**other.raw, **self.raw})

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("alphabets", "lexicon", "words", "pairs", "raw")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.usual = self.pairs | _ASCII_PAIRS
        self.letters = frozenset(c for p in self.pairs for c in p) | frozenset(map(chr, range(128)))
        self.scales = []
        for k, (data, trained) in self.raw.items():
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
            p = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=200, dict_size=len(data), format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
            self.scales.append((frozenset(self.alphabets[k]), _Recoding(self.alphabets[k]), zstandard.ZstdCompressor(dict_data=d, compression_params=p)))

    def odd(self, word: str) -> int:
        """How many pairs of neighbours with a character outside ASCII no language of the sample has.

        None in a word with letters, joined to others, that no language of the sample uses: such a word is foreign.
        """
        if any(not x.isascii() and not self.letters.issuperset(x) for x in _JOINED.findall(word)):
            return 0
        return self.strange(word)

    def strange(self, word: str) -> int:
        """``odd`` in any word."""
        t = _DIGITS.sub("0", f" {word} ")
        return len(set(map(str.__add__, t, t[1:])) - self.usual)

    def odd_up_to(self, word: str, violations: int, most: int) -> int:
        """``odd`` in a word without violations, else ``strange``; counting ends beyond ``most``."""
        t, found = _DIGITS.sub("0", f" {word} "), set()
        for p in map(str.__add__, t, t[1:]):
            if p not in self.usual:
                found.add(p)
                if len(found) > most:
                    break
        return len(found) if violations or not found else min(len(found), self.odd(word))

    def used(self, word: str) -> bool:
        """Whether the sample uses all letters of a word."""
        return all(c in self.letters or not c.isalpha() for c in word)

    def known(self, word: str) -> bool:
        """Whether all parts of a word that hold letters outside ASCII are words of the sample, and there is one."""
        parts = _cores(word)
        return bool(parts) and self.words.issuperset(parts)

    def unusual(self, key: str) -> bool:
        """Whether a run of characters outside ASCII with its neighbours holds a violation or an odd pair."""
        t = "".join(c if not c.isascii() else " " if c.isspace() else "0" if c.isdecimal() else c for c in key)
        t = f"{' ' * (not t[0].isascii())}{t}{' ' * (not t[-1].isascii())}"
        return _violations(key) > 0 or not self.pairs.issuperset(p for p in map(str.__add__, t, t[1:]) if not p.isascii())

    def length(self, text: str, candidate: bool = False) -> int:
        """Bytes that ``text`` takes with the language that suits it best.

        As a ``candidate`` only those languages are tried that use most of its characters. A sentence as it stands is
        measured with all languages, its candidates so: none gains from a dictionary that the sentence itself was denied.
        """
        scales = self.scales
        if candidate:
            chars = {c for c in text if c > "\x7f"}
            misses = [len(chars - a) for a, _, _ in scales]
            scales = [x for x, n in zip(scales, misses) if n == min(misses)]
        return min((len(c.compress(text.translate(r).encode("latin-1"))) for _, r, c in scales), default=len(text.encode("utf-8", "surrogatepass")))


def _alphabet(texts: list[str]) -> list[str]:
    """The characters outside ASCII that at least 1 % of a language's texts hold (and two of them), most frequent first."""
    seen = Counter(c for t in texts for c in set(t) if c > "\x7f" and c != LOST)
    return [c for c, n in sorted(seen.items(), key=lambda x: (-x[1], x[0])) if n >= max(2, 0.01 * len(texts))]


def _dictionary(raw: list[bytes]) -> tuple[bytes, bool]:
    """(bytes, whether they are a trained dictionary): too few samples to train on serve as they are."""
    parts = [r[i : i + 300] for r in raw for i in range(0, len(r), 300)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes(), True
    except (zstandard.ZstdError, ValueError):
        return b"\n".join(raw)[-DICTIONARY_BYTES:] or b"-" * 16, False


def _cores(word: str) -> list[str]:
    """The runs of letters of a text that hold a character outside ASCII and at least three letters, in lower case."""
    return [r.lower() for r in _LETTERS.findall(word) if not r.isascii()]


def _usual(samples: dict[str, list[str]]) -> tuple[frozenset[str], frozenset[str], frozenset[str]]:
    """What at least three texts have of ASCII runs, and at least two of words and of pairs of neighbours outside ASCII."""
    counts: dict[str, Counter] = {k: Counter() for k in USUAL}
    for found in (_tokens(t) for v in samples.values() for t in v):
        for k, c in counts.items():
            c.update(found[k])
    return tuple(frozenset(t for t, n in counts[k].items() if n >= least) for k, least in USUAL.items())


def _tokens(text: str) -> dict[str, set[str]]:
    """What of a text is counted: its letters outside ASCII, ASCII runs, words, and pairs of neighbours."""
    for d in "123456789":
        text = text.replace(d, "0")
    while "00" in text:
        text = text.replace("00", "0")
    words = set(_split(text))
    runs = set(filter(str.isprintable, filter(str.isascii, words)))
    found = {"letter": set(), "run": runs, "word": set(), "pair": set()}
    for w in words - runs:
        for k, v in zip(found, _found(w) if len(w) <= REMEMBERED_CHARS else _found.__wrapped__(w)):
            found[k].update(v)
    runs.discard("")
    return found


@lru_cache(maxsize=20_000)
def _found(word: str) -> tuple[tuple[str, ...], ...]:
    """``_tokens`` of a word without blanks whose numbers are all 0: letters, ASCII runs, words and pairs."""
    return tuple(c for c in set(word) if c > "\x7f" and c != LOST), tuple(_ASCII_RUNS.findall(word)), tuple(_cores(word)), tuple(_pairs(word))


def _foreign(result: str, word: str) -> bool:
    """Whether a result has letters of an alphabet that the word has none of, or words of letters outside ASCII alone."""
    others = lambda t: set(t.translate(_KINDS).lower()) & set("cgho")
    return not others(result) <= others(word) or bool(_ALONE.search(result)) and not _ALONE.search(word)


class Restorer:
    """Finds, per sentence, the chain of wrong readings whose undoing gives the shortest description."""

    def __init__(self, speller: Speller, before: Restorer | None = None):
        """What one ``before`` has found out about words and sentences goes on to serve, if the counts of its sample led to the same."""
        self.speller = speller
        if before and all(getattr(before.speller, k) == getattr(speller, k) for k in ("lexicon", "words", "pairs")):
            self.run, self.unusual, self.searched, self.rated, self.steps, self.undone = before.run, before.unusual, before.searched, before.rated, before.steps, before.undone
        else:
            self.run = lru_cache(maxsize=50_000)(self._run)
            self.unusual = lru_cache(maxsize=50_000)(speller.unusual)
            self.searched = lru_cache(maxsize=50_000)(self._searched)
            self.rated = lru_cache(maxsize=50_000)(self._rated)
            self.steps = lru_cache(maxsize=20_000)(self._steps)
            self.undone = lru_cache(maxsize=20_000)(self._undone)
        self.best = lru_cache(maxsize=50_000)(self._best)

    def _searched(self, word: str) -> bool:
        """Whether a word has something unusual."""
        return any(map(self.unusual, _keys(word)))

    def _run(self, run: str, whole: bool) -> str:
        w = _DIGITS.sub("0", run)
        return w if w in self.speller.lexicon or len(w) < 3 else "x" if whole else f"{w[0]}x{w[-1]}"

    def masked(self, piece: str) -> str:
        """A piece with numbers and unusual ASCII runs shortened: they are alike in every candidate but for their ends, which a multi-byte reading may have swallowed."""
        return _ASCII_RUNS.sub(lambda m: self.run(m.group(), piece[max(0, m.start() - 1) : m.start()] <= "\x7f" >= piece[m.end() : m.end() + 1]), piece)

    def _rated(self, word: str) -> tuple[int, int, bool]:
        """(violations, odd pairs, whether it is a word of the sample)."""
        n = _violations(word)
        return n, self.speller.odd(word) if not n else self.speller.strange(word), self.speller.known(word)

    def _price(self, word: str) -> float:
        """What the violations and odd pairs of a word cost."""
        if word.isascii():
            return 0.0
        bad, odd, _ = self.rated(word)
        return VIOLATION_COST * bad + ODD_COST * odd

    def _steps(self, word: str) -> dict[tuple[str, str], tuple[str, int, float]]:
        """What undoing one reading can give for a word: (read_as, written_in) -> (result, evidence, change of the price).

        Evidence is 2 if the word loses violations, becomes a word of the sample, or was UTF-8 and loses all odd pairs or
        gets two characters shorter with letters that the sample uses; 1 if another reading takes all odd pairs away and makes no letters of other alphabets and
        no words of letters outside ASCII alone, which any signs can be made into; else 0. A result with more violations or odd pairs than the word, or
        that makes a stranger of a word of the sample, is left out: sound words stay.
        """
        found, (bad, odd, known) = {}, self.rated(word)
        price = self._price(word)
        plain = not bad and any(len(c) > 3 for c in _cores(word))
        for t, (n, steps) in _readings(word, bad).items():
            shorter, most = len(t) < len(word) - 1, max(odd, n < bad)
            free = shorter and any(w == "utf_8" for _, w in steps)
            m = self.speller.odd_up_to(t, n, len(t) + 1 if free else most)
            if m > most and not free:
                continue
            k = self.speller.known(t)
            if known and not k:
                continue
            clear, better = m < odd and not m, n < bad or k > known
            weak = clear and not (plain and len(_cores(t)) == len(_cores(word))) and not _foreign(t, word)
            for r, w in steps:
                utf_8 = w == "utf_8"
                if m <= most or utf_8 and shorter:
                    strong = better or utf_8 and (clear or shorter and self.speller.used(t))
                    found[r, w] = (t, 2 if strong else int(weak and r not in SEVERAL_BYTES), VIOLATION_COST * n + ODD_COST * m - price)
        return found

    def _undone(self, text: str) -> dict[str, tuple[tuple[str, str], bool, float]]:
        """Candidates for a sentence: result -> ((read_as, written_in), whether the evidence is strong, change of the price).

        Words that a step can't explain stay as they are. Evidence is strong if it goes beyond odd pairs and enough of the
        changed words have some. Without that a step counts only if it leaves no odd word and no violation in the sentence.
        """
        words = _PARTS.split(text)
        options = [self.steps(w) if not w.isascii() else {} for w in words]
        wrong = sum(any(self.rated(w)[:2]) for w in words if not w.isascii())
        steps: dict[tuple[str, str], list] = {}
        for o in options:
            for s, (_, e, p) in o.items():
                n = steps.setdefault(s, [0, 0, 0, 0.0])
                n[0] += 1
                n[1] += e > 0
                n[2] += e > 1
                n[3] += p
        found: dict[str, tuple[tuple[str, str], bool, float]] = {}
        for s, (changed, evidence, strong, price) in steps.items():
            firm = strong > 0 and evidence >= LEAST_EVIDENCE * changed
            if firm or evidence == wrong == changed > 0:
                found.setdefault("".join([o[s][0] if s in o else w for w, o in zip(words, options)]), (s, firm, price))
        return found

    def _best(self, text: str) -> tuple[tuple[tuple[tuple[str, str], ...], float, bool], ...]:
        """((chain, bytes saved, whether the evidence is strong), ...) for one masked sentence, most first: what shortens
        it before the chain's cost.

        A description is the compressed bytes, the violations and the odd pairs, priced alike in the sentence as it stands
        and in its candidates. All candidates with evidence are compressed, but for those that would have to compress to
        less than half of what the best one takes, because of their violations and odd pairs.
        """
        gain, base = 0.0, self.speller.length(text)
        least = base
        saved: dict[tuple, tuple[float, bool]] = {}
        at: dict[str, tuple] = {text: ((), False, 0.0)}
        price = sum(map(self._price, _PARTS.split(text)))
        for step in range(1, MOST_STEPS + 1):
            after: dict[str, tuple] = {}
            for t, (c, strong, p) in at.items():
                for u, (s, firm, q) in self.undone(t).items():
                    if u != text:
                        after.setdefault(u, ((*c, s), strong or firm, p + q))
            cost = STEP_COST * step + SWITCH_COST
            at = {}
            for p, u, (c, firm, _) in sorted((x[2], u, x) for u, x in after.items()):
                # only UTF-8 read wrongly gives characters that can be read wrongly once more, and each time more of them
                if c[-1][1] == "utf_8" and p < 0 < price + p:
                    at[u] = (c, firm, p)
                if base - least / 2 - p - cost < gain - CLOSE:
                    continue
                size = self.speller.length(u, candidate=True)
                if gain - CLOSE < base - size - p - cost <= gain:  # near enough for another language's dictionary to decide
                    size = min(size, self.speller.length(u))
                s, least = base - size - p, min(least, size)
                gain = max(gain, s - cost)
                if s >= 0:
                    saved[c] = (s, firm)
            if not at:
                break
        return tuple(sorted(((c, s, f) for c, (s, f) in saved.items()), key=lambda x: (STEP_COST * len(x[0]) - x[1], x[0]))[:MOST_CHAINS])

    def _mended(self, word: str, step: tuple[str, str]) -> str:
        """A word with one step undone, unless that is impossible or makes it worse: sound words stay."""
        return word if word.isascii() else self.steps(word).get(step, (word,))[0]

    def _undo(self, text: str, chain: tuple[tuple[str, str], ...]) -> str:
        for step in chain:
            text = "".join(self._mended(x, step) for x in _PARTS.split(text))
        return text

    def judge(self, text: str | None, restore: bool = True) -> tuple[bool, str | None, str | None]:
        """(garbled, restored text, chains). A chain counts if the sentences that it suits best save more than the margin.

        Searched are the sentences with violations, or with pairs of characters that no language of the sample has. The
        chains that count are then open to all sentences of the text at no further cost. Null, empty and pure ASCII texts
        are not garbled. A text with lost characters is, even if nothing can be restored, unless it only mentions them:
        signs alone between quotes or brackets are what a text talks about.

        Without ``restore`` only the first item counts, and the search ends with the sentence that settles it: what a chain
        saves never gets less by further sentences.
        """
        if not text or text.isascii():
            return False, text, None
        if not any(self.searched(w) if len(w) <= REMEMBERED_CHARS else self._searched(w) for w in set(_foreign_words(text))):
            return LOST in text and LOST in _MENTION.sub("x", text), text, None
        plain = _MENTION.sub(lambda m: "x" * len(m.group()), text)
        if not restore and LOST in plain:
            return True, text, None
        places = [m.span() for m in _FOREIGN.finditer(plain) if self.unusual(plain[max(0, m.start() - 1) : m.end() + 1])]
        ends = [b for _, b in places]
        found, total, firm, open_ends = [], Counter(), set(), 0
        for m in _SENTENCES.finditer(plain):
            k, t = bisect_right(ends, m.start()), m.group()
            # a run of characters outside ASCII may go on over several sentences
            if k < len(places) and places[k][0] < m.end() and any(map(self.unusual, _keys(t))):
                saved = self.best(self.masked(t))
                open_ends += not saved
                if saved:
                    found.append((m.start(), m.end(), saved))
                    chain, s, strong = saved[0]
                    total[chain] += max(0.0, s - STEP_COST * len(chain) - SWITCH_COST)
                    firm |= {chain} if strong else set()
                    if not restore and chain in firm and total[chain] > MARGIN:
                        return True, text, None
        # odd pairs alone are a reason only if undoing explains all of the text
        good = {c for c, g in total.items() if g > MARGIN and (c in firm or not open_ends)}
        out, end, used = [], 0, set()
        for a, b, saved in found:
            fit = max(((s, total[c], c) for c, s, _ in saved if c in good), default=None)
            if fit:
                out += [text[end:a], self._undo(text[a:b], fit[2])]
                end = b
                used.add(fit[2])
        names = sorted(" then ".join(f"{w} read as {r}" for r, w in reversed(c)) for c in used)
        return bool(good) or LOST in plain, "".join(out) + text[end:], "; ".join(names) or None


def _pairs(text: str) -> set[str]:
    """The pairs of neighbours of a text, line ends and tabs read as blanks, that hold a character outside ASCII."""
    t = f" {text} ".replace("\n", " ").replace("\t", " ")
    return {p for k in _keys(t) for p in map(str.__add__, k, k[1:])}


def plain_texts(texts: list[str]) -> list[str]:
    """The texts without violations and lost characters: a first selection to train on, whatever is frequent among them.

    A language all of whose texts have some gives those that have the fewest.
    """
    rated = [(t.count(LOST) + violations(t), t) for t in texts]
    return [t for n, t in rated if not n] or [t for n, t in rated if n == min(rated)[0]]


_restorers: dict[str, Restorer] = {}


def _restorer(packed: bytes, name: str) -> Restorer:
    """One per Python worker, so that what it has learned about sentences serves all tasks of the worker."""
    if name not in _restorers:
        before = next(iter(_restorers.values()), None)
        _restorers.clear()
        _restorers[name] = Restorer(pickle.loads(packed), before)
    return _restorers[name]


def _mapper(speller: Speller, pick, restore: bool):
    """Arrow batches with ``text`` -> ``pick(batch, verdicts)``, judged by a restorer of the worker, which also restores them on demand."""
    packed = pickle.dumps(speller)
    name = hashlib.sha256(packed).hexdigest()

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = _restorer(packed, name)
        for b in batches:
            yield pick(b, [r.judge(t, restore) for t in b["text"]])

    return judge


def _objects(strings: dict[str, Sequence[str]], **numbers: Sequence[int]) -> pd.DataFrame:
    """Columns of Python strings and of integers."""
    return pd.DataFrame({k: pd.Series(v, dtype=object) for k, v in strings.items()} | {k: pd.Series(v, dtype="int64") for k, v in numbers.items()})


def _changes(counted: dict[str, int]):
    """Picks the sound texts with change 1, or 0 if ``counted``, their language's lowest rating, had them counted already; and with -1 the garbled ones that it had counted."""

    def pick(b: pd.DataFrame, found: list) -> pd.DataFrame:
        rows = [(x, t, (not f[0]) - (counted[x] == n)) for x, t, n, f in zip(b["lang"], b["text"], b["rating"], found)]
        lang, text, change = list(zip(*[r for r, f in zip(rows, found) if r[2] or not f[0]])) or ((), (), ())
        return _objects({"lang": lang, "text": text}, change=change)

    return pick


def _garbled(b: pd.DataFrame, found: list) -> pd.DataFrame:
    return pd.DataFrame({"doc_id": b["doc_id"][[f[0] for f in found]]})


def _restored(b: pd.DataFrame, found: list) -> pd.DataFrame:
    rows = [(f[1], f[2]) for f in found if f[0]]
    out = pd.DataFrame(rows, columns=["text", "chains"], dtype=object)
    out.insert(0, "doc_id", b["doc_id"][[f[0] for f in found]].to_numpy())
    return out


class _Tally:
    """How many texts of a language have each letter outside ASCII, ASCII run, word and pair of neighbours."""

    def __init__(self, rating: int):
        self.rating, self.texts = rating, 0
        self.counts: dict[str, Counter] = {k: Counter() for k in ("letter", *USUAL)}

    def add(self, text: str) -> None:
        self.texts += 1
        found = _tokens(text)
        for k, c in self.counts.items():
            c.update(found[k])

    def rows(self, lang: str) -> Iterator[pd.DataFrame]:
        for k, c in {"text": {"": self.texts}, **self.counts}.items():
            yield _objects({"lang": [lang] * len(c), "kind": [k] * len(c), "token": list(c)}, rating=[self.rating] * len(c), n=list(c.values()))


def _tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``(lang, text, rating)`` -> ``(lang, rating, kind, token, n)``, of each language's texts with the lowest rating in the partition."""
    best: dict[str, _Tally] = {}
    for b in batches:
        for lang, text, n in zip(b["lang"], b["text"], b["rating"]):
            if lang not in best or n <= best[lang].rating:
                if lang not in best or n < best[lang].rating:
                    best[lang] = _Tally(n)
                best[lang].add(text)
    for lang, t in best.items():
        yield from t.rows(lang)


def _tally_changes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``(lang, text, change)`` -> ``(lang, rating, kind, token, n)``, all rated 0: how the changes of 1 and -1 change the counts."""
    tallies: dict[tuple[str, int], _Tally] = {}
    for b in batches:
        for lang, text, change in zip(b["lang"], b["text"], b["change"]):
            tallies.setdefault((lang, change), _Tally(0)).add(text)
    for (lang, change), t in tallies.items():
        for rows in t.rows(lang):
            yield rows.assign(n=change * rows["n"])


def _rating(text: str) -> int:
    """0 for texts without violations and lost characters."""
    return text.count(LOST) + violations(text)


def _ratings(texts: pd.Series) -> pd.Series:
    return pd.Series([_rating(t) for t in texts], dtype="int64")


def _condensed(pieces: list[bytes]) -> list[bytes]:
    """Pieces of a language's texts, or a dictionary trained on them if they are many."""
    if sum(map(len, pieces)) <= UNCONDENSED_BYTES:
        return pieces
    return [_dictionary(pieces)[0]]


def _merged(b: pd.DataFrame) -> pd.DataFrame:
    pieces = _condensed([x for p in b["pieces"] for x in p])
    return pd.DataFrame({"lang": [b["lang"].iloc[0]], "part": [b["part"].iloc[0]], "pieces": [pieces]})


def _trained(texts: DataFrame, alphabets: dict[str, list[str]], ratings: dict[str, int]) -> dict[str, tuple[bytes, bool]]:
    """A dictionary per language from all its texts of the lowest rating: partitions condense theirs, and parts are merged until one is left."""

    def condense(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        recode = {k: _Recoding(v) for k, v in alphabets.items()}
        found: dict[str, list[bytes]] = {}
        for b in batches:
            for lang, text, n in zip(b["lang"], b["text"], b["rating"]):
                if ratings.get(lang) == n:
                    found.setdefault(lang, []).append(recode[lang].encoded(text))
        for lang, pieces in found.items():
            yield pd.DataFrame({"lang": [lang], "part": [part], "pieces": [_condensed(pieces)]})

    kind = "lang string, part bigint, pieces array<binary>"
    left, parts = texts.rdd.getNumPartitions(), texts.mapInPandas(condense, kind)
    while left > 1:
        parts, left = parts.withColumn("part", F.expr(f"part div {MERGED_PARTS}")).groupBy("lang", "part").applyInPandas(_merged, kind), -(-left // MERGED_PARTS)
    found: dict[str, list[bytes]] = {}
    for r in sorted(parts.collect(), key=lambda r: (r.lang, r.part)):
        found.setdefault(r.lang, []).extend(map(bytes, r.pieces))
    return {k: _dictionary(v) for k, v in sorted(found.items())}


_COUNTS = "lang string, rating bigint, kind string, token string, n bigint"


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("lang", "rating", "kind", "token").agg(F.sum("n").alias("n")).where(F.col("n") > 0)


def _lowest(counts: DataFrame) -> tuple[dict[str, int], DataFrame]:
    """The lowest rating of every language, and the counts of its texts with that rating, with their number as ``texts``."""
    rated = counts.where(F.col("kind") == "text").groupBy("lang").agg(F.min(F.struct("rating", "n")).alias("m")).select("lang", "m.rating", F.col("m.n").alias("texts")).collect()
    known = counts.sparkSession.createDataFrame([(r.lang, r.rating, r.texts) for r in rated], "lang string, rating bigint, texts bigint")
    return {r.lang: r.rating for r in rated}, counts.join(F.broadcast(known), ["lang", "rating"])  # a row per language


def _fitted(texts: DataFrame, ratings: dict[str, int], c: DataFrame) -> Speller:
    """The speller of those ``texts`` (``lang``, ``text``, ``rating``) that are rated lowest within their language, from their counts (see ``_lowest``)."""
    least = F.greatest(F.lit(2.0), 0.01 * F.col("texts"))
    alphabets: dict[str, list[str]] = {k: [] for k in ratings}
    for r in sorted(c.where((F.col("kind") == "letter") & (F.col("n") >= least)).collect(), key=lambda r: (r.lang, -r.n, r.token)):
        alphabets[r.lang].append(r.token)
    weight = F.sum(F.col("n") * F.least(F.lit(1.0), LANGUAGE_WEIGHT / F.col("texts")))
    total = c.groupBy("kind", "token").agg(weight.alias("weight"))
    usual: dict[str, set[str]] = {k: set() for k in USUAL}
    for r in total.where(reduce(or_, ((F.col("kind") == k) & (F.col("weight") >= w - 1e-9) for k, w in USUAL.items()))).collect():
        usual[r.kind].add(r.token)
    raw = _trained(texts, alphabets, ratings)
    return Speller.of({k: alphabets[k] for k in raw}, *(frozenset(usual[k]) for k in USUAL), raw)


def fit_speller(docs: DataFrame) -> Speller:
    """Dictionaries and counts from all labelled texts, whole and in all languages.

    Labels are read without case and surrounding blanks; null, blank and "und" label nothing. Equal texts count once.
    Texts may be garbled too: a speller of those without violations judges all of them, and the one made from what it
    leaves is the result. A language of which it leaves none keeps its first. The texts are counted once; after judging
    only those are counted whose part in the counts changes.
    """
    lang = F.lower(F.btrim("lang", F.lit(" \t")))
    labelled = docs.where(F.col("text") != "").select(lang.alias("lang"), "text").where(~F.col("lang").isin("", "und")).withColumn("digest", F.md5("text"))
    spark = docs.sparkSession
    tasks = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    with Workspace(spark, "speller") as at:
        texts = at.keep(labelled.repartition(tasks, "digest").dropDuplicates(["lang", "digest"]).select("lang", "text", F.pandas_udf(_ratings, "bigint")("text").alias("rating")))
        ratings, counts = _lowest(at.keep(_summed(texts.mapInPandas(_tally, _COUNTS))))
        plain = _fitted(texts, ratings, counts)
        judged = at.keep(texts.mapInPandas(_mapper(plain, _changes(ratings), False), "lang string, text string, change bigint"))
        changes = judged.where("change <> 0").mapInPandas(_tally_changes, _COUNTS)
        ratings, counts = _lowest(at.keep(_summed(counts.drop("texts").withColumn("rating", F.lit(0).cast("bigint")).unionByName(changes))))
        return _fitted(judged.where("change >= 0").select("lang", "text", F.lit(0).cast("bigint").alias("rating")), ratings, counts).with_languages_of(plain)


def _candidates(docs: DataFrame) -> DataFrame:
    """Texts with a character outside ASCII: all encodings here agree on ASCII, so no other text can be wrong."""
    return spread(docs.select("doc_id", "text").where(F.col("text").rlike(r"[^\x00-\x7f]")))


def garbled(docs: DataFrame) -> DataFrame:
    """``(doc_id)`` of the texts that were decoded, wholly or in places, with another encoding than they were written in.

    Every sentence with characters outside ASCII is described by the best of the per-language dictionaries, as it stands
    and as every chain of undone readings would give it; naming the chain has its cost, and the shortest wins. A text is
    garbled if its sentences save more than the cost by one chain, or if it holds characters that a failed decode lost.
    Null, empty and ASCII texts are not. Whole texts are read.
    """
    return _candidates(docs).mapInPandas(_mapper(fit_speller(docs), _garbled, False), "doc_id bigint")


def restored(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, chains)`` of the garbled texts, with their original wording as far as it is still there.

    ``chains`` names the encodings; it is null if all that is wrong is lost. Sentences outside the garbled places are
    returned as they are.
    """
    return _candidates(docs).mapInPandas(_mapper(fit_speller(docs), _restored, True), "doc_id bigint, text string, chains string")
