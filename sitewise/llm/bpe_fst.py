"""Byte-level BPE as a lazily determinised finite-state transducer, and its streaming inverse.

The merges are compiled once into a trie of token spellings and, for every token, the two parts it is
made of. Reading a chunk byte by byte, the transducer keeps the *open starts*: places from which the
bytes read so far may still grow into a token, each with the token that ends there. The last token of
the text read so far is the one spelling a suffix that stays apart from the token before it, so it
depends on the open starts alone. Equal sets of open starts are one state; states and their
transitions are made when first needed and kept, and forgotten all together beyond a bound.

A token is final once the chains of last tokens from all open starts meet behind it. No token is longer
than the longest spelling, so the lookahead is bounded; long chunks are emitted piecewise.

Two neighbouring tokens stay apart if at no moment of the merging a pair across their border would be
merged before the parts it would take are used up by the merges inside the tokens.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

# Fixed value: the published pattern that cuts a text into chunks for this family of vocabularies.
CHUNKS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MAX_STATES = 200_000
MAX_CHUNKS_KEPT = 200_000
LONGEST_CHUNK_KEPT = 64
EMIT_EVERY = 4096


def default_vocabulary() -> str:
    """Where the public vocabulary file lies on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def _letters() -> dict[str, int]:
    """Byte-level vocabularies write every byte as one printable letter."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Compiled merges of one vocabulary file, with its lazily made states."""

    def __init__(self, path: str, max_states: int = MAX_STATES):
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _letters()
        spell = {t: bytes(letters[c] for c in t) for t in model["vocab"] if all(c in letters for c in t)}
        ids = {t: i for t, i in model["vocab"].items() if t in spell}
        self.spelling = {i: spell[t] for t, i in ids.items()}
        self.length = {i: len(s) for i, s in self.spelling.items()}
        self.formed: dict[int, int] = {i: -1 for i, s in self.spelling.items() if len(s) == 1}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for n, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            whole = ids.get(a + b)
            if whole is None:
                continue
            self.rank.setdefault(ids[a] << 20 | ids[b], n)
            if whole not in self.formed:
                self.formed[whole], self.parts[whole] = n, (ids[a], ids[b])
        self.edge: dict[int, int] = {}
        self.token_at: dict[int, int] = {}
        nodes = 1
        for i, s in self.spelling.items():
            if i not in self.formed:
                continue
            at = 0
            for b in s:
                nxt = self.edge.get(at << 8 | b)
                if nxt is None:
                    nxt = self.edge[at << 8 | b] = nodes
                    nodes += 1
                at = nxt
            self.token_at[at] = i
        self.inner = {k >> 8 for k in self.edge}
        self.chunks = regex.compile(CHUNKS)
        self.max_states = max_states
        self.kept: dict[str, tuple[int, ...]] = {}
        self._apart: dict[int, bool] = {}
        self._forget()

    def _forget(self) -> None:
        """Back to the start state only: no open start but the chunk's beginning, which has no token before it."""
        self.states: list[tuple] = [((0, -1),)]
        self.number: dict[tuple, int] = {self.states[0]: 0}
        self.step: dict[int, tuple[int, int]] = {}

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether ``left`` before ``right`` is how their joint text is encoded. -1 as left: a beginning."""
        if left < 0:
            return True
        key = left << 20 | right
        known = self._apart.get(key)
        if known is None:
            if len(self._apart) > 4 * self.max_states:
                self._apart.clear()
            known = self._apart[key] = self._unwind(left, right)
        return known

    def _unwind(self, x: int, y: int) -> bool:
        # until when each border part lasts; going back in time, the part formed last is split first
        x_until = y_until = 1 << 60
        while True:
            r = self.rank.get(x << 20 | y)
            if r is not None and r < x_until and r <= y_until:
                return False
            fx, fy = self.formed[x], self.formed[y]
            if fx < 0 and fy < 0:
                return True
            if fx > fy:
                x_until, x = fx, self.parts[x][1]
            else:
                y_until, y = fy, self.parts[y][0]

    def _make(self, state: int, byte: int) -> tuple[int, int]:
        """The transition of a state on a byte: next state and the last token of the text then read."""
        grown, last = [], None
        for node, before in self.states[state]:
            nxt = self.edge.get(node << 8 | byte)
            if nxt is None:
                continue
            token = self.token_at.get(nxt)
            if last is None and token is not None and self.stays_apart(before, token):
                last = token  # starts run from the longest suffix to the shortest
            if nxt in self.inner:
                grown.append((nxt, before))
        grown.append((0, last))
        key = tuple(grown)
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.states)
            self.states.append(key)
        made = self.step[state << 8 | byte] = (number, last)
        return made

    def _common(self, last: list[int], starts: Iterable[int]) -> int:
        """The latest place through which the chains of last tokens from all the places pass."""
        places = set(starts)
        while len(places) > 1:
            top = max(places)
            places.remove(top)
            places.add(top - self.length[last[top]])
        return places.pop()

    def _chain(self, last: list[int], end: int) -> list[int]:
        out = []
        while end > 0:
            out.append(last[end])
            end -= self.length[last[end]]
        return out[::-1]

    def _depths(self, state: int) -> list[int]:
        return [self._depth(node) for node, _ in self.states[state]]

    def _depth(self, node: int) -> int:
        if not hasattr(self, "_depth_of"):
            self._depth_of = {0: 0}
            for k, nxt in self.edge.items():  # parents come before children
                self._depth_of[nxt] = self._depth_of[k >> 8] + 1
        return self._depth_of[node]

    def run(self, data: bytes) -> Iterator[int]:
        """Token ids of one chunk of bytes, emitted as soon as they are final."""
        if len(self.states) > self.max_states:
            self._forget()
        state, last, step = 0, [-1], self.step
        for byte in data:
            t = step.get(state << 8 | byte)
            if t is None:
                t = self._make(state, byte)
            state = t[0]
            last.append(t[1])
            if len(last) > EMIT_EVERY:
                n = len(last) - 1
                done = self._common(last, [n - d for d in self._depths(state)])
                if done > 0:
                    yield from self._chain(last, done)
                    # places before ``done`` are never looked at again
                    last = [-1, *last[done + 1 :]]
        yield from self._chain(last, len(last) - 1)

    def encode(self, text: str | None) -> list[int]:
        """Token ids of a text without special tokens; empty for null and empty texts."""
        out: list[int] = []
        if not text:
            return out
        kept = self.kept
        for chunk in self.chunks.findall(text):
            ids = kept.get(chunk)
            if ids is None:
                ids = self.run(chunk.encode("utf-8", "surrogatepass"))
                if len(chunk) <= LONGEST_CHUNK_KEPT:
                    if len(kept) >= MAX_CHUNKS_KEPT:
                        kept.clear()
                    ids = kept[chunk] = tuple(ids)
            out.extend(ids)
        return out


class Utf8Stream:
    """Incremental UTF-8: bytes in, characters out as soon as they are complete; U+FFFD for broken ones."""

    def __init__(self) -> None:
        self.need, self.code, self.low, self.high = 0, 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out = []
        for b in data:
            if self.need:
                if self.low <= b <= self.high:
                    self.code, self.need, self.low, self.high = self.code << 6 | b & 0x3F, self.need - 1, 0x80, 0xBF
                    if not self.need:
                        out.append(chr(self.code))
                    continue
                self.need, self.low, self.high = 0, 0x80, 0xBF
                out.append("�")
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self.need, self.code = 1, b & 0x1F
            elif 0xE0 <= b <= 0xEF:
                self.need, self.code = 2, b & 0x0F
                self.low, self.high = (0xA0 if b == 0xE0 else 0x80), (0x9F if b == 0xED else 0xBF)
            elif 0xF0 <= b <= 0xF4:
                self.need, self.code = 3, b & 0x07
                self.low, self.high = (0x90 if b == 0xF0 else 0x80), (0x8F if b == 0xF4 else 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def finish(self) -> str:
        rest = "�" if self.need else ""
        self.need = 0
        return rest


def decode(transducer: Transducer, ids: Iterable[int]) -> str:
    """The text of token ids."""
    stream = Utf8Stream()
    return "".join([*(stream.feed(transducer.spelling[i]) for i in ids), stream.finish()])


@lru_cache(maxsize=2)
def compiled(path: str) -> Transducer:
    """One transducer per worker process and vocabulary."""
    return Transducer(path)
