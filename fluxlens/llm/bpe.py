"""Byte-level BPE: token ids, and exact token counts of every prefix of a text.

The number of tokens of a prefix follows from a dynamic program over the bytes
of one pre-token: an encoding is valid exactly if each adjacent pair of its
tokens is, and a string has one valid encoding only, so the last token of
prefix j is the one suffix that is in the vocabulary and fits the last token
of the prefix before it.  Counts are kept for each distinct unit of text and
strung together for whole texts.  New units of a batch are solved together,
column by column, with numpy.  Caches belong to one worker process, are
bounded, and hold nothing that cannot be computed again.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

#: Units after which the cache is emptied (about 200 bytes each).
CACHE_UNITS = 700_000
#: Longest pre-token (bytes) that is solved together with others.
TOGETHER_BYTES = 48
#: Slots (a power of two) of the table of known token pairs.
PAIR_SLOTS = 1 << 20

_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same without looking ahead: equal where no two white-space characters meet.
_PLAIN_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
_TWO_SPACES = re.compile(r"\s\s")
#: A unit is one pre-token, or a run of white space with the pre-token behind it:
#: what is before a unit has no say in how it or any prefix of it is encoded.
_UNIT = r"'(?:[sdmt]|ll|ve|re)| ?L+| ?N+| ?P+|\s+ (?:L+|N+|P+)|\s+(?:'(?:[sdmt]|ll|ve|re)|L+|N+|P+)?"
_UNITS = regex.compile(_UNIT.replace("L", r"\p{L}").replace("N", r"\p{N}").replace("P", r"[^\s\p{L}\p{N}]"))
#: Texts of these characters alone are cut by the faster standard module.
_COMMON = re.compile("[^\t\n\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f\u2010-\u2027]")
_COMMON_UNITS = re.compile(_UNIT.replace("L", "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]").replace("N", "[0-9]").replace("P", "[!-/:-@\\[-`{-~\u2010-\u2027]"))
_SPACES = regex.compile(r"\s+")
_ONE = regex.compile(r"'(?:[sdmt]|ll|ve|re)|\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+")
_AFTER_SPACE = regex.compile(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+")
#: Two pieces as long as their last character is missing.
_SHORTENED = ("'ll", "'ve", "'re")


def units(text: str) -> list[str]:
    """The text in units whose prefixes are encoded independently of what is before them."""
    return (_UNITS if _COMMON.search(text) else _COMMON_UNITS).findall(text)


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE files: printable Latin-1 bytes
    stand for themselves, the others are numbered from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _by_length(pieces: set[str]) -> Iterable[tuple[int, list[str], list[bytes]]]:
    """Pieces of equal numbers of bytes together."""
    groups: dict[int, tuple[list[str], list[bytes]]] = defaultdict(lambda: ([], []))
    for p in pieces:
        raw = p.encode()
        names, all_raw = groups[len(raw)]
        names.append(p)
        all_raw.append(raw)
    for length, (names, all_raw) in groups.items():
        yield length, names, all_raw


class ByteBPE:
    """A byte-level BPE vocabulary read from a tokenizer's JSON file.

    ``encode`` gives ids as the file's own library does with
    ``add_special_tokens=False``; ``prefix_counts`` gives the number of ids of
    every prefix of a text.  Special strings inside texts become their own id,
    which is that library's default.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = spec.get("pre_tokenizer") or {}
        if spec["model"].get("type", "BPE") != "BPE" or spec.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError("only byte-level BPE without normaliser and prefix space, cut by its own pattern, is counted")
        alphabet = _byte_alphabet()
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
        self.ranks = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.token = {i: t for t, i in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self._full, self._plain = (tiktoken.Encoding("own", pat_str=p, mergeable_ranks=self.ranks, special_tokens={})._core_bpe for p in (_PATTERN, _PLAIN_PATTERN))
        self._split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._known: dict[str, bytes | None] = {}
        self._tree: tuple[np.ndarray, np.ndarray] | None = None

    # -- ids ---------------------------------------------------------------

    def parts(self, text: str) -> list[str]:
        """The text split so that every special string stands alone at an odd place."""
        if self._split_special is None or not any(s in text for s in self.special):
            return [text]
        return self._split_special.split(text)

    def encode(self, text: str) -> np.ndarray:
        """Token ids as little-endian unsigned 32-bit integers."""
        core = self._full if _TWO_SPACES.search(text) else self._plain
        ids = []
        for k, x in enumerate(self.parts(text)):
            ids += [self.special[x]] if k % 2 else core.encode_ordinary(x)
        return np.array(ids, "<u4")

    # -- prefix counts -----------------------------------------------------

    def _trie(self) -> tuple[np.ndarray, np.ndarray]:
        """Next state by (state, byte), 0 being dead and 1 the start; token by state, or -1."""
        if self._tree is None:
            states: dict[bytes, int] = {b"": 1}
            for t in self.ranks:
                for k in range(1, len(t) + 1):
                    states.setdefault(t[:k], len(states) + 1)
            after, token = np.zeros((len(states) + 1, 256), np.int32), np.full(len(states) + 1, -1, np.int32)
            for t, k in states.items():
                if t:
                    after[states[t[:-1]], t[-1]] = k
                    token[k] = self.ranks.get(t, -1)
            self._tree = after, token
            self._pair, self._pair_fits = np.full(PAIR_SLOTS, -1, np.int64), np.zeros(PAIR_SLOTS, bool)
        return self._tree

    def _fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens is what its joined bytes encode to."""
        keys = a.astype(np.int64) << 20 | b
        slots = (keys * 0x9E3779B1 >> 12) & (PAIR_SLOTS - 1)
        known = self._pair[slots] == keys
        fits = self._pair_fits[slots]
        if not known.all():
            at = np.flatnonzero(~known)
            new, back = np.unique(keys[at], return_inverse=True)
            single, token = self._full.encode_single_piece, self.token
            found = np.array([single(token[x >> 20] + token[x & 0xFFFFF]) == [x >> 20, x & 0xFFFFF] for x in new.tolist()])
            fits[at] = found[back]
            self._pair[slots[at]], self._pair_fits[slots[at]] = keys[at], fits[at]
        return fits

    def _solve(self, pieces: list[bytes], length: int) -> np.ndarray:
        """Number of tokens of every byte prefix of pieces of one length: one row each."""
        after, token_of = self._trie()
        text = np.frombuffer(b"".join(pieces), np.uint8).reshape(-1, length)
        n = len(text)
        last, count = np.zeros((length + 1, n), np.int32), np.zeros((length + 1, n), np.int32)
        alive: list[tuple[np.ndarray, np.ndarray]] = []  # rows and states by where the token starts
        for j in range(1, length + 1):
            byte = text[:, j - 1]
            alive.append((np.arange(n), np.ones(n, np.int32)))
            open_ = np.ones(n, bool)
            for i in range(j):
                rows, state = alive[i]
                if not len(rows):
                    continue
                state = after[state, byte[rows]]
                if not state.all():
                    keep = state != 0
                    rows, state = rows[keep], state[keep]
                alive[i] = rows, state
                token = token_of[state]
                at = (token >= 0) & open_[rows]
                rows, token = rows[at], token[at]
                if i and len(rows):
                    at = self._fits(last[i, rows], token)
                    rows, token = rows[at], token[at]
                last[j, rows], count[j, rows] = token, count[i, rows] + 1
                open_[rows] = False
        return count[1:].T

    def _solve_long(self, piece: bytes) -> np.ndarray:
        """The same for one long piece, position by position."""
        self._trie()
        n, ranks = len(piece), self.ranks
        last, count = [-1] * (n + 1), [0] * (n + 1)
        fits: dict[tuple[int, int], bool] = {}
        single = self._full.encode_single_piece
        for j in range(1, n + 1):
            for i in range(max(0, j - self.longest), j):
                if (token := ranks.get(piece[i:j])) is None:
                    continue
                pair = last[i], token
                if i and pair not in fits:
                    fits[pair] = single(self.token[last[i]] + self.token[token]) == [last[i], token]
                if not i or fits[pair]:
                    last[j], count[j] = token, count[i] + 1
                    break
        return np.array(count[1:], np.int32)

    def _pieces(self, unit: str) -> list[tuple[str, int]]:
        """Pre-tokens whose prefix counts make up those of a unit; how many of their characters count as such."""
        found, pos = [], 0
        while pos < len(unit):
            if run := _SPACES.match(unit, pos):
                run, pos = run[0], run.end()
                if pos < len(unit) and run == " ":
                    body = _AFTER_SPACE.match(unit, pos)
                    found.append((" " + body[0], 0))
                    pos = body.end()
                else:
                    found.append((run, 1))
                    if pos < len(unit) and run[-1] == " ":
                        body = _AFTER_SPACE.match(unit, pos)
                        found.append((" " + body[0], 2))
                        pos = body.end()
                    elif pos < len(unit):
                        found.append((run[-1], 3))
            else:
                body = _ONE.match(unit, pos)
                found.append((body[0], 0))
                pos = body.end()
        return found

    def _learn(self, new: Iterable[str]) -> None:
        """Puts the differences of the prefix counts of new units into the cache."""
        rest, pieces = {}, set()
        for u in new:
            first = u[0]
            if u in _SHORTENED:
                rest[u] = [(u, 0)]
            elif (first == " " and len(u) > 1 and not u[1].isspace()) or not first.isspace():
                pieces.add(u)
            else:
                rest[u] = self._pieces(u)
        others = {p for ps in rest.values() for p, _ in ps}
        steps: dict[str, bytes | None] = {}
        counts: dict[str, np.ndarray] = {}
        for length, names, raw in _by_length(pieces | others):
            table = self._solve(raw, length) if length <= TOGETHER_BYTES else np.stack([self._solve_long(x) for x in raw])
            joined = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, length)
            ends = np.ones(joined.shape, bool)  # at the ends of characters
            ends[:, :-1] = joined[:, 1:] & 0xC0 != 0x80
            flat, to = table[ends], np.cumsum(ends.sum(axis=1))
            differences = np.diff(flat, prepend=0)
            differences[to[:-1]] = flat[to[:-1]]
            spans = list(zip([0, *to.tolist()], to.tolist()))
            small = differences.astype(np.int8).tobytes()
            steps.update(zip(names, [small[a:b] for a, b in spans]))
            if np.abs(differences).max() > 127:
                steps.update((p, None) for p, (a, b) in zip(names, spans) if np.abs(differences[a:b]).max() > 127)
            counts.update((p, flat[a:b]) for p, (a, b) in zip(names, spans) if p in others)
        for u, ps in rest.items():
            found, base = [], 0
            for p, kind in ps:
                c = counts[p]
                if p in _SHORTENED:
                    c = np.array([1, 2, c[-1]])
                if kind == 3:  # the run's last character alone, behind the others
                    base += c[-1]
                elif kind == 1:
                    found.append(base + c)
                    base += c[-2] if len(c) > 1 else 0
                else:
                    found.append(base + (c[1:] if kind == 2 else c))
                    base += c[-1]
            differences = np.diff(np.concatenate(found), prepend=0)
            steps[u] = differences.astype(np.int8).tobytes() if np.abs(differences).max() < 128 else None
        self._known |= steps

    def prefix_deltas(self, texts: list[str]) -> list[np.ndarray]:
        """For each text the differences of its prefix counts, one for each code
        point: int8, or int32 where they need it."""
        if len(self._known) > CACHE_UNITS:
            self._known.clear()
        get, cut, found, new = self._known.get, [], [], set()
        for t in texts:
            c = units(t) if not self._special_in(t) else None
            f = None if c is None else list(map(get, c))
            if c and None in f:
                new.update(u for u, x in zip(c, f) if x is None)
                f = None
            cut.append(c)
            found.append(f)
        if new := new.difference(self._known):
            self._learn(new)
        out = []
        for text, c, f in zip(texts, cut, found):
            try:
                out.append(np.frombuffer(b"".join(map(get, c) if f is None else f), np.int8))
            except TypeError:  # special strings, or a unit whose counts jump
                out.append(np.diff(np.array(self._slow_counts(text), np.int32), prepend=np.int32(0)))
        return out

    def _special_in(self, text: str) -> bool:
        return any(s in text for s in self.special)

    def _slow_counts(self, text: str) -> list[int]:
        """Prefix counts of a text with special strings, or with counts that jump."""
        out, base, parts = [], 0, self.parts(text)
        for k, part in enumerate(parts):
            if k % 2:
                # Short of its last character a special string is ordinary text behind what precedes it.
                out += [start + c for c in self._plain_counts(parts[k - 1] + part[:-1])[len(parts[k - 1]) :]] + [base + 1]
                base += 1
            else:
                start, counts = base, self._plain_counts(part)
                out += [base + c for c in counts]
                base += counts[-1] if counts else 0
        return out

    def _plain_counts(self, text: str) -> list[int]:
        out, base = [], 0
        for u in units(text):
            for p, kind in self._pieces(u) if u not in _SHORTENED else [(u, 0)]:
                raw = p.encode()
                c = [x for x, following in zip(self._solve_long(raw).tolist(), raw[1:] + b"a") if following & 0xC0 != 0x80]
                if p in _SHORTENED:
                    c = [1, 2, c[-1]]
                if kind != 3:
                    out += [base + x for x in (c[1:] if kind == 2 else c)]
                base += (c[-2] if len(c) > 1 else 0) if kind == 1 else c[-1]
                end = out[-1]
            base = end
        return out

    def prefix_counts(self, text: str) -> np.ndarray:
        """Number of tokens of text[:1], text[:2], ..., text."""
        return np.cumsum(self.prefix_deltas([text])[0], dtype=np.int64)


def longest_prefix(deltas: np.ndarray, budget: int) -> int:
    """Length of the longest prefix of at most ``budget`` tokens, from the stored differences alone."""
    counts = np.cumsum(deltas, dtype=np.int64)
    fitting = np.flatnonzero(counts <= budget)
    return int(fitting[-1]) + 1 if len(fitting) else 0


@lru_cache(maxsize=4)
def load(path: str) -> ByteBPE:
    """The vocabulary of a file, once for each worker process."""
    return ByteBPE(path)


@lru_cache(maxsize=4)
def library(path: str) -> Tokenizer:
    """The public library's own tokenizer, for tests and for other kinds of file."""
    return Tokenizer.from_file(path)
