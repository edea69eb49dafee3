"""Token counts at every prefix of a text, by dynamic programming over prefixes.

For byte-pair encodings an encoding's own prefix is the encoding of the shorter text, so the last token of a
prefix of length k is the one token t ending at k that may stand after the last token of the prefix of length
k - len(t); the count at k is then the count there plus one. The tokens that end at k are known from the longest
end of the prefix that begins a token, which the next symbol carries on (``Endings``), so none is looked for in vain.
One pass over a word gives the exact count at each of its prefixes, and truncation or budget questions are answered from those counts without encoding again.
"""

from __future__ import annotations

import json
import operator
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_rows

#: Fixed value: the word pattern of the lower-casing word-end vocabulary (it is also in the tokenizer file).
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
#: What of ASCII is neither letter, digit nor white space for that pattern.
MARKS = "".join(c for c in map(chr, range(128)) if WORD.fullmatch(c) and not c.isalnum())
#: str.split() treats these as white space, the tokenizer does not.
ODD = re.compile("[\x1c-\x1f]")
SPACE = regex.compile(r"\p{White_Space}")
#: Symbols of a word up to which the word after it may share its prefixes.
SHARED = 48
#: Characters of texts whose new words are counted at once, in order.
GROUP = 2 << 20
#: Words and chunks whose counts are kept per worker, as many again of those before; what is gone is counted anew.
RECENT = 350_000
#: Pairs of tokens and steps from place to place kept per worker.
PAIRS, PLACES = 1_000_000, 200_000


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Kept(dict):
    """Values by string, made when first asked for; once there are many, those not asked for since the last time go."""

    def __init__(self, make: Callable, longest: int):
        self.make, self.longest, self.before = make, longest, {}

    def __missing__(self, key: str):
        if (value := self.before.get(key)) is None:
            value = self.make(key)
        self.keep(key, value)
        return value

    def keep(self, key: str, value) -> None:
        if len(key) <= self.longest:
            if len(self) >= RECENT:
                self.before = dict(self)
                self.clear()
            self[key] = value


class Follows(dict):
    """Which tokens may stand after one token, found out when first asked for."""

    def __init__(self, counter: PrefixCounter, token: str):
        self.counter, self.token = counter, token

    def __missing__(self, other: str) -> bool:
        self.counter.bound_pairs()
        found = self[other] = self.counter.may_follow(self.token, other)
        return found


class Endings(dict):
    """By a place and the next symbol: the place there, and the tokens that end there, longest first.

    A place is the longest end of what was read that begins a token. Tokens come with their lengths, and those within a
    word with what may follow them, apart from those at its end, which bear the end's mark.
    """

    def __init__(self, inner: set[str], final: set[str], end: str, after: Callable[[str], Follows]):
        self.inner, self.final, self.end, self.after = inner, final, end, after
        self.begins = {t[:k] for t in inner | final for k in range(1, len(t) + 1)}
        self.known: dict[str, tuple] = {}

    def __missing__(self, read: str) -> tuple[str, list, list]:
        place = next((read[i:] for i in range(len(read)) if read[i:] in self.begins), "")
        if len(self) >= PLACES:
            self.clear()
            self.known.clear()
        if (found := self.known.get(place)) is None:
            ends = [place[i:] for i in range(len(place))]
            inner, final = [(t, len(t), self.after(t)) for t in ends if t in self.inner], [(t + self.end, len(t)) for t in ends if t in self.final]
            found = self.known[place] = place, inner, final
        self[read] = found
        return found


class PrefixCounter:
    """Exact token counts at all prefixes, for a word-end BPE tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.end = spec["model"]["end_of_word_suffix"]
        self.symbol = byte_symbols()
        n = len(self.end)
        self.inner, self.final = set(), set()
        for t in spec["model"]["vocab"]:
            (self.final.add(t[:-n]) if t.endswith(self.end) and len(t) > n else self.inner.add(t))
        self.follows: dict[str, Follows] = {}
        self.pairs = 0
        self.endings = Endings(self.inner, self.final, self.end, self.after)
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(spec["model"]["merges"])}
        self.halves = list(self.rank)
        self.made = {a + b: i for i, (a, b) in enumerate(self.halves)}
        self.rest = {self.symbol[b] for b in range(0x80, 0xC0)}  # bytes within a character
        self.special = [t["content"] for t in spec.get("added_tokens", ())]
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.word_steps, self.chunk_steps = Kept(self.word_inside, SHARED), Kept(self.chunk_inside, 4 * SHARED)
        # of the prefixes of the word before, by length: what may follow and the count, the place, what shared_steps() gives
        self.last = ""
        self.states, self.places, self.steps = ([first] * (SHARED + 1) for first in ((self.after(""), 0), ("", [], []), (b"", 0)))

    def may_follow(self, a: str, b: str) -> bool:
        """Whether ``b`` (with the end's mark if it is a word's last token) stays apart from ``a`` when both are encoded together.

        The merges that built both are undone from the latest on. Whenever the two pieces beside the border could have
        merged before the merge just undone, the border would have gone; if that never happens it stays.
        """
        made, halves = self.made, self.halves
        x, y, before = a, b, 1 << 60
        while True:
            if self.rank.get((x, y), 1 << 60) < before:
                return False
            m, n = made.get(x, -1), made.get(y, -1)
            if m < 0 and n < 0:
                return True
            if m > n:
                before, x = m, halves[m][1]
            else:
                before, y = n + 1, halves[n][0]

    def bound_pairs(self) -> None:
        self.pairs += 1
        if self.pairs > PAIRS:
            self.pairs = 0
            for f in self.follows.values():
                f.clear()

    def after(self, token: str) -> Follows:
        if (found := self.follows.get(token)) is None:
            found = self.follows[token] = Follows(self, token)
        return found

    def long_word(self, s: str) -> tuple[bytes, int]:
        """``shared_steps`` of a long word of symbols; memory is linear in the word."""
        endings, states, place = self.endings, [(self.after(""), 0)], ""
        counts = []
        for k in range(1, len(s) + 1):
            place, inner, final = endings[place + s[k - 1]]
            if k == len(s) or s[k] not in self.rest:
                counts.append(self.chosen(s, k, final, states)[0])
            count, follows = self.chosen(s, k, inner, states)
            states.append((follows, count))
        return differences(counts), counts[-1]

    @staticmethod
    def chosen(s: str, k: int, ending: list[tuple], states: list) -> tuple:
        """Token count of the symbols s[:k], whose last token is one of those ``ending`` there, and what comes with that token."""
        for t, size, *more in ending:
            last, count = states[k - size]
            if last[t]:
                return count + 1, *more
        raise ValueError(f"no encoding of {s[:k]!r}")

    def shared_steps(self, s: str) -> tuple[bytes, int]:
        """``differences`` of the whole words that the prefixes of ``s`` are, and the last count.

        States of the prefixes that ``s`` shares with the word before it are taken over, so words should come in order.
        """
        states, places, steps, endings, rest, before = self.states, self.places, self.steps, self.endings, self.rest, self.last
        known, n, self.last = 0, len(s), ""
        for a, b in zip(s, before):  # noqa: B905 - one may be longer
            if a != b:
                break
            known += 1
        inner_known = max(0, min(known, len(before) - 1))  # the last symbol's state as the start of a longer word was not needed yet
        found, place = steps[known], places[known]
        for k in range(known + 1, n + 1):
            if k - 1 > inner_known:
                for t, size, follows in place[1]:  # chosen(), written out
                    last, count = states[k - 1 - size]
                    if last[t]:
                        states[k - 1] = follows, count + 1
                        break
                else:
                    raise ValueError(f"no encoding of {s[: k - 1]!r}")
            places[k] = place = endings[place[0] + s[k - 1]]
            if k == n or s[k] not in rest:  # a character ends here
                for t, size in place[2]:
                    last, count = states[k - size]
                    if last[t]:
                        found = found[0] + STEP[count + 1 - found[1]], count + 1
                        break
                else:
                    raise ValueError(f"no encoding of {s[:k]!r}")
            steps[k] = found
        self.last = s
        return found

    def whole_word(self, word: str) -> tuple[bytes, int]:
        """``differences`` of the counts at each prefix of a normalised word as words of their own, and the count of the whole."""
        s = word if word.isascii() and word.isprintable() else "".join(map(self.symbol.__getitem__, word.encode()))
        return self.long_word(s) if len(s) > SHARED else self.shared_steps(s)

    def word_inside(self, word: str) -> tuple[bytes, int]:
        """The same of the text that the word is."""
        if word[0] == "'" and len(word) > 1 and word[1].isalpha():  # cut short, these are not one word
            counts = [sum(self.whole_word(p)[1] for p in WORD.findall(word[:i])) for i in range(1, len(word) + 1)]
            return differences(counts), counts[-1]
        return self.whole_word(word)

    @staticmethod
    def normal(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "\u03a3" in text:  # a final sigma has a form of its own in str.lower(), not in the tokenizer
                return "".join(c.lower() for c in text)
        return text.lower()

    @staticmethod
    def words_of(chunk: str) -> list[str]:
        """Words of a normalised chunk without white space and special strings."""
        if chunk.isascii():  # letters and marks after them are the usual case, and quick to tell
            letters = chunk.rstrip(MARKS)
            if letters.isalpha():
                return [letters, chunk[len(letters) :]] if len(letters) < len(chunk) else [chunk]
        return WORD.findall(chunk)

    def words_inside(self, words: list[str]) -> tuple[bytes, int]:
        """The same of words in turn."""
        if len(words) == 1:
            return self.word_steps[words[0]]
        found = list(map(self.word_steps.__getitem__, words))
        return b"".join([f[0] for f in found]), sum([f[1] for f in found])

    def chunk_inside(self, chunk: str) -> tuple[bytes, int]:
        """The same of a chunk without white space; a whole special string is one token."""
        if not (self.cut and "<|" in chunk):
            return self.words_inside(self.words_of(self.normal(chunk)))
        out = []
        for i, part in enumerate(self.cut.split(chunk)):
            steps, count = self.words_inside(WORD.findall(part.lower() if i % 2 else self.normal(part)))
            out.append((differences([*counts_of(steps).tolist()[:-1], 1]), 1) if i % 2 else (steps, count))
        return b"".join([m[0] for m in out]), sum([m[1] for m in out])

    def learn(self, chunks: set[str]) -> None:
        """Count chunks that are new, their words in order."""
        kept = self.chunk_steps
        new = [c for c in chunks if c not in kept and c not in kept.before and "<|" not in c]
        words = list(map(self.words_of, self.normal("\n".join(new)).split("\n"))) if new else []
        for w in sorted(set(chain.from_iterable(words))):
            self.word_steps[w]
        for c, found in zip(new, map(self.words_inside, words), strict=True):
            kept.keep(c, found)

    @staticmethod
    def parts(text: str) -> list[str]:
        return text.split() if not ODD.search(text) else [p for p in regex.split(r"\p{White_Space}+", text) if p]

    def ends(self, text: str) -> list[int]:
        """Tokens of each chunk in turn: their running sums are the counts at the prefixes that end a chunk."""
        return self.prefixes_of(text)[1]

    def prefixes_of(self, text: str, parts: list[str] | None = None) -> tuple[bytes, list[int]]:
        """``deltas`` of a text, and what ``ends`` gives, both from the counts at the prefixes of its chunks."""
        if parts is None:
            parts = self.parts(text)
        known = list(map(self.chunk_steps.__getitem__, parts))
        steps = list(map(FIRST, known))
        if parts and SPACE.match(text[0]):
            steps.insert(0, b"")
        if text and SPACE.match(text[-1]):
            steps.append(b"" if parts else NONE)
        return NONE.join(steps), list(map(SECOND, known))

    def prefixes_of_all(self, texts: list[str]) -> Iterator[tuple[bytes, list[int]]]:
        """``prefixes_of`` each text, a group of them at a time."""
        start, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size > GROUP or i == len(texts) - 1:
                group = [(t, self.parts(t)) for t in texts[start : i + 1]]
                self.learn(set().union(*(parts for _, parts in group)))
                for t, parts in group:
                    yield self.prefixes_of(t, parts)
                start, size = i + 1, 0

    def deltas(self, text: str) -> bytes:
        """For each character of the normalised text, by how much the count of the prefix that ends there differs from the one before."""
        return self.prefixes_of(text)[0]


#: Differences as 16 bits, as far as words whose prefixes are kept have them; that at white space.
STEP = {d: np.int16(d).tobytes() for d in range(-2 * SHARED, 2 * SHARED)}
NONE = STEP[0]
FIRST, SECOND = operator.itemgetter(0), operator.itemgetter(1)


def differences(counts: list[int]) -> bytes:
    """Counts at the prefixes of 1, 2, ... characters as differences of 16 bits from one to the next."""
    return array("h", map(operator.sub, counts, [0, *counts])).tobytes()


def last_count(deltas: bytes) -> int:
    """The token count at the last prefix, the whole text; 0 if there is none."""
    return int(np.frombuffer(deltas, np.int16).sum(dtype=np.int64))


def counts_of(deltas: bytes) -> np.ndarray:
    """Token counts at the prefixes of 1, 2, ... characters."""
    return np.cumsum(np.frombuffer(deltas, np.int16), dtype=np.int64)


def longest_within(deltas: bytes, budget: int) -> int:
    """The most characters of the normalised text whose encoding has at most ``budget`` tokens."""
    fits = np.flatnonzero(counts_of(deltas) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def prefix_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", inside: bool = True) -> DataFrame:
    """Token counts of every text at its prefixes.

    Returns per row: the id, n_bytes (UTF-8), n_tokens, chunk_tokens (tokens of each chunk between white space in turn, so
    that running sums are the counts of the prefixes that end there) and prefix_deltas (the same by character of the
    normalised text, see ``counts_of`` and ``longest_within``; null unless ``inside``, and then n_tokens is the count at
    the last prefix). A null or empty text has 0 bytes,
    0 tokens and no prefixes. Repeated ids are counted row by row, a null id stays null, no rows give no rows, and other
    columns are not read.
    """
    schema = f"{id_col} long, n_bytes long, n_tokens long, chunk_tokens array<int>, prefix_deltas binary"

    def make():
        c = counter(tokenizer)

        def run(part: pa.RecordBatch) -> list:
            texts = [t or "" for t in part.column(1).to_pylist()]
            deltas, ends = zip(*c.prefixes_of_all(texts), strict=True)
            offsets = np.cumsum([0, *map(len, ends)])
            flat = np.concatenate([np.array(e, np.int32) for e in ends])
            sums = np.concatenate([[0], np.cumsum(flat, dtype=np.int64)])
            chunks = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            counts = list(map(last_count, deltas)) if inside else np.diff(sums[offsets])
            if not inside:
                deltas = [None] * len(texts)
            return [part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), chunks, pa.array(deltas, pa.binary())]

        return run

    return map_rows(docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col)), make, schema, text=1)
