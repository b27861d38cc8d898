"""Folding of spellings before matching: case, width, accents, look-alikes, digits, stars, gaps.

``fold`` turns a text into plain words. A word of letters only stays as it is (without accents, in
lower case). Any other word is read in several ways, and the first reading that is a known word wins:
signs between letters dropped, look-alike letters of another script, digits and signs as letters,
repeated letters, swapped neighbours, hidden letters (stars and the like) by the rest of the word.
Words that no reading explains fall apart at their signs, and each part is read by itself. Letters
written with gaps are joined. Nothing is cut: readings are followed together through a tree of the known
words, in one walk over the word however long it is.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from functools import lru_cache

# Letters of other scripts that look like Latin ones, and signs used for letters.
LOOK_ALIKES = dict(zip("аеорсухкмтніјѕԁԛԝвһьոսɡıαεορυχκτνιηβγω", "aeopcyxkmtnijsdqwbhbnugiaeopyxktvinbyw"))
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "+": "t", "|": "il", "€": "e", "£": "l", "¡": "i", "(": "c", "ß": "s"}
HIDERS = set("*#$%&@!?^~_+•·×✱")
WORD_ENDS = ("s", "es", "ed", "er", "ers", "ing", "y", "in", "n", "e", "en")
_OUTER = ".,;:?\"'()[]{}<>«»„“”‘’…¿¡-–—_/\\`|=~"
_LETTER = re.compile(r"[^\W\d_]")
_ASCII_WORD = re.compile(r"[a-z]+\Z")


def plain(text: str) -> str:
    """Compatibility forms, lower case, without accents and without characters that show nothing."""
    if text.isascii():
        return text.lower()
    t = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text).casefold())
    return "".join(c for c in t if unicodedata.category(c) not in ("Mn", "Cf", "Me")).replace("ς", "σ").replace("ё", "е")


def _tree(words: dict[str, str]) -> dict:
    """Letters as nested maps; "" holds the word that ends there."""
    root: dict = {}
    for w, meant in words.items():
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node.setdefault("", meant)
    return root


class Folder:
    """Readings of odd spellings against a set of known words."""

    def __init__(self, words: set[str], soft: set[str], phrases: set[str] = frozenset()):
        """words: a case by themselves; soft: words that only count together with others; phrases: words that occur in phrases."""
        base = {plain(w) for w in words}
        self.known = base | {plain(w) for w in soft}
        self.inflected = {w + e for w in base if len(w) >= 4 for e in WORD_ENDS} | {w[:-1] + "ies" for w in base if w.endswith("y")} | {plain(w) + "s" for w in soft}
        every = self.known | self.inflected
        told = every | {w for w in phrases if len(w) >= 4}
        self.reading: dict[str, str] = {w: w for w in told}
        self.collapsed = {re.sub(r"(.)\1+", r"\1", w): w for w in sorted(told, key=lambda w: (len(w), w not in every), reverse=True)}
        self.swapped: dict[str, str] = {}
        for w in sorted(base, key=len, reverse=True):
            if len(w) >= 4:
                for form in (w, w + "s"):
                    for i in range(len(form) - 1):
                        v = form[:i] + form[i + 1] + form[i] + form[i + 2 :]
                        if v not in told and (i > 0 or len(w) > 5):
                            self.swapped.setdefault(v, form)
        self.by_length: dict[int, list[str]] = defaultdict(list)
        for w in sorted(every):
            if len(w) >= 3:
                self.by_length[len(w)].append(w)
        self.strong_by_length: dict[int, list[str]] = defaultdict(list)
        for w in sorted(base | self.inflected):
            if len(w) >= 4:
                self.strong_by_length[len(w)].append(w)
        joined = sorted((w for w in base if len(w) >= 4), key=len, reverse=True)
        self.inside = re.compile("|".join(map(re.escape, joined))) if joined else None
        self.exact = _tree({**{w: w for w in self.swapped}, **{w: w for w in told}})
        self.thin = _tree(self.collapsed)
        self._kept = lru_cache(maxsize=200_000)(self._word)

    def word(self, raw: str) -> str:
        """The reading of a word; short ones are kept."""
        return self._kept(raw) if len(raw) <= 64 else self._word(raw)

    def _lookup(self, w: str) -> str | None:
        if w in self.reading:
            return w
        if w in self.swapped:
            return self.swapped[w]
        if len(w) >= 5 and re.search(r"(.)\1\1", w) or re.search(r"(.)\1{3,}", w):
            thin = re.sub(r"(.)\1+", r"\1", w)
            return self.collapsed.get(thin)
        return None

    def _hidden(self, w: str) -> str | None:
        """A word with hidden letters: all shown letters agree, the first is shown, and enough are shown."""
        shown = sum(c not in HIDERS for c in w)
        if shown < 2 or w[0] in HIDERS:
            return None
        pool = self.by_length if shown >= 2 and w[-1] not in HIDERS else self.strong_by_length
        for k in pool.get(len(w), ()):
            if all(a in HIDERS or a == b for a, b in zip(w, k)) and (shown * 2 >= len(w) - 1 or "*" in w or "#" in w):
                return k
        return None

    def _word(self, raw: str) -> str:
        w = raw.strip(_OUTER)
        if not w:
            return ""
        if _ASCII_WORD.match(w) or w.isalpha():
            found = self._lookup(w)
            if found is None and not w.isascii():
                found = self._lookup("".join(LOOK_ALIKES.get(c, c) for c in w))
            return found or w
        bare = w.rstrip("!+*?$#%&@^~")
        forms = [w, bare] if bare != w else [w]
        if not _LETTER.search(w):
            return " ".join(re.findall(r"\w+", w))
        for f in forms:
            latin = "".join(LOOK_ALIKES.get(c, c) for c in f)
            for g in (f, latin):
                together = "".join(c for c in g if c.isalpha())
                if len(together) >= 3 and not any(c in HIDERS or c.isdigit() for c in g):
                    found = self._lookup(together)
                    if found:
                        return found
                found = self._signs(g)
                if found:
                    return found
                if any(c in HIDERS for c in g):
                    found = self._hidden("".join(c for c in g if c.isalnum() or c in HIDERS))
                    if found:
                        return found
        return " ".join(p if p == w else self.word(p) for p in re.findall(r"[^\W_]+", w))

    def _signs(self, w: str) -> str | None:
        """The known word that one of the readings of signs as letters gives; exact ones before those with repeated letters."""
        letters = [o for o in (c if c.isalpha() else SIGNS.get(c, "") for c in w) if o]
        if len(letters) < 3:
            return None
        at = [self.exact]
        for options in letters:
            at = [n[o] for n in at for o in options if o in n]
            if not at:
                break
        hits = [n[""] for n in at if "" in n]
        if hits:
            return self._lookup(hits[0])
        # (node, last letter, letters in a row up to 4, three in a row seen): few, as equal ones are merged
        states = {(id(self.thin), "", 0, False): self.thin}
        for options in letters:
            new = {}
            for (_, last, row, seen), node in states.items():
                for o in options:
                    if o == last:
                        new[id(node), o, min(row + 1, 4), seen or row >= 2] = node
                    elif o in node:
                        new[id(node[o]), o, 1, seen] = node[o]
            states = new
            if not states:
                return None
        for (_, _, row, seen), node in states.items():
            if "" in node and seen and len(letters) >= 5:
                return node[""]
        return None

    def _join_gaps(self, words: list[str]) -> list[str]:
        """Runs of three or more single characters: the known words inside the joined run, if there are any."""
        out, i = [], 0
        while i < len(words):
            j = i
            while j < len(words) and len(words[j].strip(_OUTER)) == 1 and not words[j].isdigit():
                j += 1
            if j - i >= 3:
                run = "".join(w.strip(_OUTER) for w in words[i:j])
                # the run may go on into the next word when that begins with hidden letters
                found = self.inside.findall(run) if self.inside else []
                if not found:
                    read = self._signs(run) or self._hidden(run) or self._lookup(run)
                    found = [read] if read else []
                out.extend(found or words[i:j])
                i = j
            else:
                out.append(words[i])
                i += 1
        return out

    def fold(self, text: str) -> list[str]:
        words = self._join_gaps(plain(text).split())
        return " ".join([self.word(w) for w in words]).split()
