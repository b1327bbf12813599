"""Byte-level BPE with the tokenizers library, each distinct word encoded once per worker.

The pre-tokenizer's pattern never joins characters across a single space that stands between two
other visible characters; it only gives that space to the word after it. So a text may be cut before such spaces,
and the ids of the parts, one after the other, are the ids of the whole text. Parts repeat, so a bounded
memory of parts saves most of the work. tests/llm/test_tokens.py holds this against whole-text encoding.

Texts that hold a special token as plain text, and all texts of a tokenizer with another pre-tokenizer, are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from itertools import repeat

import numpy as np
import pyarrow as pa

from .common import buffer_of, ramp
from .rolling import MASKS, eights, of_bytes

#: Where a text may be cut. Python's \s includes all that the tokenizer's pattern takes for white space.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space for which cutting at every space would be wrong.
_IRREGULAR = re.compile("[\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
#: Before a line's first letter, and the letters that a part begins with.
_LINE, _LETTERS = re.compile(r"(?<=\S)(?=\n[^\W\d_])"), re.compile(r"[ \n][^\W\d_]+(?=\W)")
#: Parts longer than this are not remembered. Beyond so many parts or ids (about 250 MB together), those that came again stay and the rest is forgotten.
LONGEST, CAPACITY, CAPACITY_IDS = 48, 1_000_000, 8_000_000


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def parts_of(text: str) -> list[str]:
    """The text's parts; every part but the first lacks the space that it starts with."""
    if "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or _IRREGULAR.search(text):
        return _CUT.split(text)
    return text.split(" ")


class Encoder:
    """encode() gives all ids of some texts as one array. With spans, also each token's first and last character."""

    def __init__(self, path: str, spans: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.spans = spans
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        before = told.get("pre_tokenizer") or {}
        #: Cutting is right for this pre-tokenizer, without a normalizer, and for texts without special tokens.
        self.may_cut = before.get("type") == "ByteLevel" and before.get("use_regex") is not False and not before.get("add_prefix_space") and not told.get("normalizer") and told["model"].get("type") == "BPE" and not told["model"].get("dropout")
        self.special = [x["content"] for x in told.get("added_tokens", []) if x["content"]]
        # a byte-level token has one letter for each of its bytes
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.n_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        self.n_bytes[list(vocab.values())] = [len(x) for x in vocab]
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.atoms: dict[str, int] = {}
        self.at = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int64)
        self.uses = np.zeros(1 << 16, np.int64)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.begin = np.zeros(1 << 18 if self.spans else 0, np.int32)
        self.end = np.zeros(1 << 18 if self.spans else 0, np.int32)
        self.n, self.m = 0, 0

    def _forget(self) -> None:
        """Keep what was used twice or more since the last time, if that leaves half of the memory free; else nothing."""
        known, atoms, at, size = self.known, self.atoms, self.at, self.size
        ids, begin, end = self.ids, self.begin, self.end
        stays = np.flatnonzero(self.uses[: self.n] > 1)
        self._reset()
        if 2 * len(stays) > CAPACITY or 2 * size[stays].sum() > CAPACITY_IDS:
            return
        take = np.repeat(at[stays], size[stays]) + ramp(size[stays])
        self._add(size[stays], ids[take], *((begin[take], end[take]) if self.spans else (None, None)))
        new = np.full(len(at), -1, np.int64)
        new[stays] = np.arange(len(stays))
        self.known.update((p, n) for p, k in known.items() if (n := int(new[k])) >= 0)
        self.atoms.update((p, n) for p, k in atoms.items() if (n := int(new[k])) >= 0)

    def _add(self, size: np.ndarray, ids: np.ndarray, begin, end) -> np.ndarray:
        """Keep the ids of some parts; the numbers that stand for the parts."""
        while self.n + len(size) > len(self.at):
            self.at, self.size, self.uses = (np.resize(x, 2 * len(x)) for x in (self.at, self.size, self.uses))
        while self.m + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
            if self.spans:
                self.begin, self.end = np.resize(self.begin, len(self.ids)), np.resize(self.end, len(self.ids))
        self.at[self.n : self.n + len(size)] = self.m + np.cumsum(size) - size
        self.size[self.n : self.n + len(size)] = size
        self.uses[self.n : self.n + len(size)] = 0
        self.ids[self.m : self.m + len(ids)] = ids
        if self.spans:
            self.begin[self.m : self.m + len(ids)], self.end[self.m : self.m + len(ids)] = begin, end
        self.n, self.m = self.n + len(size), self.m + len(ids)
        return np.arange(self.n - len(size), self.n)

    def _one_by_one(self, texts: list[str], lead: np.ndarray | None = None) -> np.ndarray:
        """Encode texts by themselves; `lead`: so many characters of each are not counted."""
        encode = self.library.encode_batch if self.spans else self.library.encode_batch_fast
        found = encode(texts, add_special_tokens=False)
        size = np.array([len(x.ids) for x in found], np.int64)
        ids = np.array([i for x in found for i in x.ids], np.uint32)
        if not self.spans:
            return self._add(size, ids, None, None)
        flat = np.array([s for x in found for s in x.offsets], np.int32).reshape(-1, 2)
        if lead is not None:
            flat -= np.repeat(lead, size)[:, None].astype(np.int32)
        return self._add(size, ids, flat[:, 0], flat[:, 1])

    def _joined(self, atoms: list[str], skip: bool = False) -> np.ndarray:
        """Encode atoms that begin with a space or new line and end with a visible character, as one text. skip: without each atom's first token."""
        encode = self.library.encode_batch if self.spans else self.library.encode_batch_fast
        found = encode(["".join(atoms)], add_special_tokens=False)[0]
        ids = np.array(found.ids, np.uint32)
        ends = np.cumsum(np.fromiter((len(p.encode()) for p in atoms), np.int64, len(atoms)))
        last = np.searchsorted(np.cumsum(self.n_bytes[ids]), ends, side="right")
        size = np.diff(last, prepend=0)
        begin = end = None
        if self.spans:
            chars = np.fromiter(map(len, atoms), np.int64, len(atoms))
            origin = np.repeat(np.cumsum(chars) - chars + 1 + skip, size)
            flat = np.array(found.offsets, np.int64).reshape(-1, 2)
            begin, end = flat[:, 0] - origin, flat[:, 1] - origin
        new = self._add(size, ids, begin, end)
        if skip:
            self.at[new] += 1
            self.size[new] -= 1
        return new

    def _atoms(self, atoms: set[str]) -> dict[str, int]:
        """Learn atoms, which are parts, or the letters and the rest of parts."""
        got: dict[str, int] = {}
        ready, glued, odd = [], [], []
        for x in atoms:
            (odd if x[-1:].isspace() or x[:2].isspace() and len(x) > 1 else ready if x[0] in " \n" else glued).append(x)
        for lo in range(0, len(ready), 4000):
            got.update(zip(some := ready[lo : lo + 4000], self._joined(some).tolist()))
        for lo in range(0, len(glued), 4000):  # after a letter, what begins with another sign stands alone
            got.update(zip(some := glued[lo : lo + 4000], self._joined([" a" + x for x in some], True).tolist()))
        if odd:
            # like the others': characters from after a space or new line, or from their own first
            got.update(zip(odd, self._one_by_one(odd, np.array([x[0] in " \n" for x in odd], np.int64)).tolist()))
        self.atoms.update((x, k) for x, k in got.items() if len(x) <= LONGEST)
        return got

    def _learn(self, parts: list[str]) -> list[int]:
        """The numbers of parts that are not known yet. Where letters end, and before a new line, a part may be cut again."""
        known, out, words, ended, mixed = self.known, {}, [], [], {}
        for p in dict.fromkeys(parts):
            if p.isalpha():
                words.append(p)
            elif p[:-1].isalpha() and not p[-1].isalnum() and not p[-1].isspace():
                ended.append(p)
            else:
                mixed[p] = atoms = []
                for y in _LINE.split(" " + p):
                    m = _LETTERS.match(y)
                    if m and not y[-1].isspace():
                        atoms += [m[0], y[m.end() :]]
                    else:
                        atoms.append(y)
        # a word with one sign after it: the word is a part of its own
        bases = [p[:-1] for p in ended]
        new = set(bases).difference(known)
        new.update(words)
        new = list(new)
        for lo in range(0, len(new), 4000):
            some = new[lo : lo + 4000]
            out.update(zip(some, self._joined([" " + p for p in some]).tolist()))
        wanted = {x for atoms in mixed.values() for x in atoms} | {p[-1] for p in ended}
        found = {x: k for x in wanted if (k := self.atoms.get(x)) is not None}
        found.update(self._atoms(wanted.difference(found)))
        known.update(out)
        group = np.concatenate([np.full(len(ended), 2), np.fromiter(map(len, mixed.values()), np.int64, len(mixed))])
        if len(group):
            flat = np.empty(int(group.sum()), np.int64)
            flat[: 2 * len(ended) : 2] = np.fromiter(map(known.__getitem__, bases), np.int64, len(bases))
            flat[1 : 2 * len(ended) : 2] = np.fromiter((found[p[-1]] for p in ended), np.int64, len(ended))
            flat[2 * len(ended) :] = [found[x] for atoms in mixed.values() for x in atoms]
            heads = np.cumsum(group) - group
            self.uses[: self.n] += np.bincount(flat, minlength=self.n)
            size = self.size[flat]
            take = np.repeat(self.at[flat], size) + ramp(size)
            begin = end = None
            if self.spans:
                # an atom's characters are counted from after its space, or for the others from their own first
                own = [x for p, base in zip(ended, bases) for x in (" " + base, p[-1])] + [x for atoms in mixed.values() for x in atoms]
                chars = np.fromiter(map(len, own), np.int64, len(own))
                before = np.cumsum(chars) - chars
                before -= np.repeat(before[heads], group)
                lead = np.fromiter((x[0] not in " \n" for x in own), np.int64, len(own))
                shift = np.repeat(before - lead, size)
                begin, end = self.begin[take] + shift, self.end[take] + shift
            names = ended + list(mixed)
            out.update(zip(names, self._add(np.add.reduceat(size, heads), self.ids[take], begin, end).tolist()))
            known.update((p, out[p]) for p in names if len(p) <= LONGEST)
        result = [out.get(p, -1) for p in parts]
        for p in [p for p in new if len(p) > LONGEST]:
            del known[p]
        return result

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, ...]:
        """(ids, bounds): text i has ids[bounds[i]:bounds[i + 1]]. A null text has no ids. With spans, two more arrays: characters [begin, end)."""
        if self.n > CAPACITY or self.m > CAPACITY_IDS:
            self._forget()
        firsts, rest, counts = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                p = parts_of(text) if self.may_cut and not any(x in text for x in self.special) else [text]
                counts[i] = len(p)
                firsts.append(p[0])
                rest += p
        if not rest:
            none = np.zeros(0, np.int64)
            return (none.astype(np.uint32), np.zeros(len(texts) + 1, np.int64), *([none, none] * self.spans))
        held = counts[counts > 0]
        head = np.cumsum(held) - held
        which = np.fromiter(map(self.known.get, rest, repeat(-1)), np.int64, len(rest))
        which[head] = self._one_by_one(firsts)  # a text's first part has no space before it
        missing = np.flatnonzero(which < 0).tolist()
        if missing:
            which[missing] = self._learn([rest[j] for j in missing])
        self.uses[: self.n] += np.bincount(which, minlength=self.n)
        size = self.size[which]
        ends = np.cumsum(size)
        take = np.repeat(self.at[which] - (ends - size), size) + np.arange(ends[-1])
        per_text = np.zeros(len(texts), np.int64)
        per_text[counts > 0] = np.add.reduceat(size, head)
        out = (self.ids[take], np.concatenate([[0], np.cumsum(per_text)]))
        if self.spans:
            # where each part begins among its text's characters: one space before all but the first
            chars = np.fromiter(map(len, rest), np.int64, len(rest)) + 1
            before = np.cumsum(chars) - chars
            before -= np.repeat(before[head], held)
            place = np.repeat(before, size)
            out += (place + self.begin[take], place + self.end[take])
        return out


#: Bytes beside a space that make cutting at every space wrong: the first bytes of white space other than space and new line, and what must follow them (None: nothing).
_ODD_BYTES = {**{b: None for b in (9, 11, 12, 13, 28, 29, 30, 31)}, 0xC2: (0x85, 0xA0), 0xE1: (0x9A,), 0xE2: (0x80, 0x81), 0xE3: (0x80,)}
#: Longer parts, in bytes, are not remembered by name.
LONGEST_BYTES = 4 * LONGEST
_MULTIPLY, _GLUED = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Ids(Encoder):
    """An Encoder of ids alone, for columns: parts are found among the bytes of all texts at once and looked up by their names (64 bits, and 64 more of their first bytes and
    length), so that nothing is done part by part but for parts that are new.

    Texts are cut finer here than at spaces: between letters or digits and ASCII signs other than the apostrophe, and around a new line that stands alone, where the pre-tokenizer ends
    a word, too. So a word is one part whatever sign follows it. What has no space before it, is a part of another kind than with one."""

    def __init__(self, path: str):
        self.lead, self.word, self.sign = np.zeros((3, 256), bool)
        self.lead[list(_ODD_BYTES)] = True
        self.word[[b for b in range(128) if chr(b).isalnum()]] = True
        self.sign[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = True
        # of letters of two bytes those from U+00C0 to U+00FF are known by their bytes, less the two signs among them
        self.second = np.zeros(256, bool)
        self.second[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True
        super().__init__(path)

    def _reset(self) -> None:
        super()._reset()
        self.key = np.zeros((2, 1 << 16), np.uint64)
        self.named = np.zeros(1 << 16, bool)
        self.bits = 18
        self.table = np.full(1 << self.bits, -1, np.int32)

    # names of parts in an open table: entries are numbers of parts

    def _places(self, h: np.ndarray) -> np.ndarray:
        return ((h * _MULTIPLY) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, h: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The numbers of the parts of these names, -1 for those that are not known."""
        out, at = np.full(len(h), -1, np.int64), self._places(h)
        open_ = np.arange(len(h))
        while len(open_):
            entry = self.table[at]
            same = (entry >= 0) & (self.key[0][entry] == h[open_]) & (self.key[1][entry] == h2[open_])
            out[open_[same]] = entry[same]
            further = (entry >= 0) & ~same
            open_, at = open_[further], (at[further] + 1) & (len(self.table) - 1)
        return out

    def _put(self, number: np.ndarray) -> None:
        """Enter parts whose names are in self.key, each name once."""
        if 2 * (int(self.named.sum()) + len(number)) > len(self.table):
            self.bits += 2
            self.table = np.full(1 << self.bits, -1, np.int32)
            number = np.concatenate([np.flatnonzero(self.named), number])
        self.named[number] = True
        at = self._places(self.key[0][number])
        while len(number):
            free = self.table[at] < 0
            self.table[at[free]] = number[free]
            rest = self.table[at] != number
            number, at = number[rest], (at[rest] + 1) & (len(self.table) - 1)

    def _name(self, number: np.ndarray, h: np.ndarray, h2: np.ndarray) -> None:
        while self.key.shape[1] < len(self.at):
            self.key = np.concatenate([self.key, np.zeros_like(self.key)], axis=1)
            self.named = np.concatenate([self.named, np.zeros_like(self.named)])
        self.key[0][number], self.key[1][number] = h, h2
        self._put(number)

    def _forget(self) -> None:
        """Keep what has a name and was used twice or more since the last time, if that leaves half of the memory free; else nothing."""
        at, size, ids, key = self.at, self.size, self.ids, self.key
        n = min(self.n, len(self.named))
        stays = np.flatnonzero(self.named[:n] & (self.uses[:n] > 1))
        self._reset()
        if 2 * len(stays) > CAPACITY or 2 * size[stays].sum() > CAPACITY_IDS:
            return
        take = np.repeat(at[stays], size[stays]) + ramp(size[stays])
        self._name(self._add(size[stays], ids[take], None, None), *key[:, stays])

    @staticmethod
    def _names(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        view, size = eights(data), end - start
        return of_bytes(data, start, end, 21, view), (view[start] & MASKS[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * _MULTIPLY)

    def _names_of(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = [p.encode() for p in parts]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        end = np.cumsum(size)
        return (*self._names(np.frombuffer(b"".join(raw), np.uint8), end - size, end), size)

    def _new(self, parts: list[str]) -> np.ndarray:
        """Learn parts that are not known, each once."""
        bases = list({p[:-1] for p in parts if p[:-1].isalpha() and not p[-1].isalnum() and not p[-1].isspace()})
        if bases:
            found = self._find(*self._names_of(bases)[:2]).tolist()
            self.known = {p: k for p, k in zip(bases, found) if k >= 0}
        have = set(self.known)
        numbers = np.array(self._learn(parts), np.int64)
        learnt = {p: k for p, k in self.known.items() if p not in have}
        self.known = {}
        h, h2, size = self._names_of(list(learnt))
        keep = size <= LONGEST_BYTES
        self._name(np.fromiter(learnt.values(), np.int64, len(learnt))[keep], h[keep], h2[keep])
        return numbers

    def _odd(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """For each text whether it may not be cut at every space."""
        space, line = data == 32, data == 10
        white = space | line
        bad = np.flatnonzero(white[:-1] & white[1:])
        lead = np.flatnonzero(self.lead[data])
        for b, after in _ODD_BYTES.items():
            at = lead[data[lead] == b]
            if after is not None and len(at):
                at = at[np.isin(data[np.minimum(at + 1, len(data) - 1)], after)]
            bad = np.concatenate([bad, at])
        raw = data.tobytes()
        for mark in self.special:
            at = raw.find(mark.encode())
            while at >= 0:
                bad = np.append(bad, at)
                at = raw.find(mark.encode(), at + 1)
        odd = np.zeros(len(bounds) - 1, bool)
        odd[np.searchsorted(bounds, bad, side="right") - 1] = True
        full = np.flatnonzero(np.diff(bounds) > 0)
        odd[full] |= white[bounds[full]] | white[bounds[full + 1] - 1]
        return odd | (not self.may_cut)

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of a column (or list) of texts, as Encoder.encode."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        if self.n > CAPACITY or self.m > CAPACITY_IDS:
            self._forget()
        data, bounds = buffer_of(column)
        n = len(column)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        odd = self._odd(data, bounds)
        start, end, counts, glued = self._cut(data, bounds, odd)
        raw = data.tobytes()
        h, h2 = self._names(data, start, end)
        h2 ^= glued * _GLUED
        which = self._find(h, h2)
        missing = np.flatnonzero(which < 0)
        if len(missing):
            _, first, back = np.unique(h[missing] ^ (h2[missing] * _MULTIPLY), return_index=True, return_inverse=True)
            first = missing[first]
            which[missing] = self._new_words([raw[s:e] for s, e in zip(start[first].tolist(), end[first].tolist())], glued[first], h[first], h2[first])[back]
        others = np.flatnonzero((np.diff(bounds) > 0) & odd)
        if len(others):
            which, counts = self._with_others(which, counts, others, [raw[bounds[i] : bounds[i + 1]].decode() for i in others.tolist()])
        self.uses[: self.n] += np.bincount(which, minlength=self.n)
        size = self.size[which]
        ends = np.cumsum(size)
        take = np.repeat(self.at[which] - (ends - size), size) + np.arange(ends[-1])
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return self.ids[take], upto

    def _cut(self, data: np.ndarray, bounds: np.ndarray, odd: np.ndarray):
        """(start, end, parts of each text, glued) of the parts of texts that are not odd. glued: no space stands before the part."""
        space, line = data == 32, data == 10
        two = np.zeros(len(data), bool)  # where the second byte of a letter stands
        two[1:] = (data[:-1] == 0xC3) & self.second[data[1:]]
        ends, begins = self.word[data] | two, self.word[data]
        begins[:-1] |= two[1:]
        sign = self.sign[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = (ends[:-1] & sign[1:]) | (sign[:-1] & begins[1:]) | space[:-1] | line[:-1] | line[1:]
        full = np.flatnonzero(np.diff(bounds) > 0)
        cut[bounds[full]] = True
        cut[-1] = False
        start = np.flatnonzero(cut & ~np.append(space, True))
        owner = np.searchsorted(bounds, start, side="right") - 1
        if odd.any():
            start, owner = start[~odd[owner]], owner[~odd[owner]]
        stop = bounds[owner + 1]
        end = np.minimum(np.append(start[1:], len(data)), stop)
        end -= (end < stop) & space[end - 1]
        glued = (start == bounds[owner]) | ~space[np.maximum(start - 1, 0)]
        return start, end, np.bincount(owner, minlength=len(bounds) - 1), glued

    def _new_words(self, parts: list[bytes], glued: np.ndarray, h: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Learn parts without white space (or a new line alone), each once."""
        out = np.zeros(len(parts), np.int64)
        for kind, lead in ((False, b" "), (True, b"\n")):
            at = [j for j in np.flatnonzero(glued == kind).tolist() if parts[j] != b"\n"]
            for lo in range(0, len(at), 4000):
                some = at[lo : lo + 4000]
                out[some] = self._joined_bytes([lead + parts[j] for j in some], kind)
        for j, p in enumerate(parts):
            if p == b"\n":
                out[j] = self._one_by_one(["\n"])[0]
        keep = np.fromiter(map(len, parts), np.int64, len(parts)) <= LONGEST_BYTES
        self._name(out[keep], h[keep], h2[keep])
        return out

    def _joined_bytes(self, words: list[bytes], skip: bool) -> np.ndarray:
        """As _joined, of ids alone."""
        found = self.library.encode_batch_fast([b"".join(words).decode()], add_special_tokens=False)[0]
        ids = np.array(found.ids, np.uint32)
        last = np.searchsorted(np.cumsum(self.n_bytes[ids]), np.cumsum(np.fromiter(map(len, words), np.int64, len(words))), side="right")
        new = self._add(np.diff(last, prepend=0), ids, None, None)
        if skip:
            self.at[new] += 1
            self.size[new] -= 1
        return new

    def _look_up(self, h: np.ndarray, h2: np.ndarray, size: np.ndarray, part) -> np.ndarray:
        """The numbers of parts that have a space before them."""
        which = self._find(h, h2)
        missing = np.flatnonzero(which < 0)
        if len(missing):
            _, first, back = np.unique(h[missing] ^ (h2[missing] * _MULTIPLY), return_index=True, return_inverse=True)
            which[missing] = self._new([part(j) for j in missing[first].tolist()])[back]
        return which

    def _with_others(self, which: np.ndarray, counts: np.ndarray, others: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all texts' parts, with those of texts that are cut with care put in where they belong."""
        split = [_CUT.split(x) if self.may_cut and not any(m in x for m in self.special) else [x] for x in texts]
        more = np.fromiter(map(len, split), np.int64, len(split))
        found, head = np.empty(int(more.sum()), np.int64), np.zeros(int(more.sum()), bool)
        head[np.cumsum(more) - more] = True
        rest = [p for x in split for p in x[1:]]  # a text's first part has no space before it
        if rest:
            found[~head] = self._look_up(*self._names_of(rest), rest.__getitem__)
        found[head] = self._one_by_one([x[0] for x in split])
        owner = np.concatenate([np.repeat(np.arange(len(counts)), counts), np.repeat(others, more)])
        counts = counts.copy()
        counts[others] = more
        return np.concatenate([which, found])[np.argsort(owner, kind="stable")], counts


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, spans: bool = False) -> Encoder:
    """One encoder per worker process, kept between tasks."""
    if (path, spans) not in _encoders:
        _encoders[path, spans] = Encoder(path, True) if spans else Ids(path)
    return _encoders[path, spans]
