"""A cache of bounded size and the pre-token encoder that uses it."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable

import numpy as np


class Recent:
    """A cache of bounded size: a newer half, and an older one that is dropped when the newer is full.

    Keys longer than 64 characters aren't kept."""

    def __init__(self, most: int) -> None:
        self.most, self.new, self.old = most // 2, {}, {}

    def get(self, key: str):
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: str, value) -> None:
        if len(key) <= 64:
            if len(self.new) >= self.most:
                self.old, self.new = self.new, {}
            self.new[key] = value

    def all(self, keys: list[str], missing: Callable[[list[str]], list]) -> list:
        """The values of keys; missing() makes those of the distinct keys that aren't here."""
        out = list(map(self.new.get, keys))
        if None not in out:
            return out
        gaps = [i for i, v in enumerate(out) if v is None]
        made = dict.fromkeys(keys[i] for i in gaps)
        old = self.old
        lost = [k for k in made if (v := old.get(k)) is None or made.__setitem__(k, v)]
        if lost:
            made.update(zip(lost, missing(lost), strict=True))
        for k, v in made.items():
            self.put(k, v)
        for i in gaps:
            out[i] = made[keys[i]]
        return out


#: Pre-tokens that a worker keeps.
KEPT = 800_000
#: Blanks that any tokenizer of this kind splits at; what lies between them is a pre-token here. str.split() knows the same ones
#: and four controls more.
_BLANKS = re.compile("[ \n\t\r]+")
_CONTROLS = "\x1c\x1d\x1e\x1f"
#: Letters (but one whose lower case is two characters) that lower-casing maps one to one and composition leaves alone.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
#: A word of these, and the ASCII marks behind it.
_CLEAN = re.compile(rf"([{_LETTERS}]+)([!-/:-@\[-`{{-~]*)")

_encoders: dict[str, PretokenEncoder] = {}


class PretokenEncoder:
    """A vocabulary file of the tokenizers library whose pre-tokens never span a blank.

    True of word-end vocabularies, which drop white space before they merge: the ids of a text are those of
    its blank-separated pre-tokens in a row. check() proves it on a probe when the file is opened."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.counts, self.packed = Recent(KEPT), Recent(KEPT)
        size = self.tokenizer.get_vocab_size()
        ends = np.zeros(1 << 16 if self.narrow else size, bool)
        ends[[i for word, i in self.tokenizer.get_vocab().items() if word.endswith("</w>")]] = True
        self.ends = ends if ends.any() else None
        # Lower-case words of letters need neither the normaliser nor the pattern of pre-tokens.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        probe = "Ab, c1's\n\t d  <|endoftext|> é ß"
        if self._ids([probe])[0] != [i for part in self._ids(self.pretokens(probe)) for i in part]:
            raise ValueError("this vocabulary joins text across white space")
        self._shortcuts_hold()

    def _shortcuts_hold(self) -> None:
        """Turns the shortcuts of _packs off where a probe of cases, letters and marks has other ids by them than by the library."""
        probe = "The THE the Spark, SPARK. spark; USA, usa. Iowa zebra. Zebra QuIcKly, McDonald it's dogs' Then### a.b <|endoftext|>".split()
        letters = re.findall(f"[{_LETTERS}]", "".join(map(chr, range(0x180))))
        probe += letters + ["".join(letters[i : i + 7]) for i in range(0, len(letters), 7)]
        marks = re.findall(r"[!-/:-@\[-`{-~]", "".join(map(chr, range(128))))
        probe += [f"Mark{a}" for a in marks] + [f"mark{a}{b}" for a in marks for b in marks[::5]]
        if self._packs(probe) != self._library(probe):
            self.ends = None
        self.packed = Recent(KEPT)

    @classmethod
    def of(cls, path: str) -> PretokenEncoder:
        """The encoder of a file, opened once in each process."""
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    @staticmethod
    def pretokens(text: str) -> list[str]:
        if any(c in text for c in _CONTROLS):
            return [x for x in _BLANKS.split(text) if x]
        return text.split()

    def _ids(self, parts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _library(self, parts: list[str]) -> list[bytes]:
        """Packed ids by the library as it is."""
        code = "H" if self.narrow else "I"
        return [struct.pack(f"<{len(i)}{code}", *i) for i in self._ids(parts)]

    def _packs(self, parts: list[str]) -> list[bytes]:
        """Packed ids. Words of _CLEAN share their lower-case form's ids, which the cache may hold, and marks behind them are a
        piece of text of their own; unknown forms are encoded as one text, whose ids are parted behind each word end."""
        if self.ends is None:
            return self._library(parts)
        known = self.packed
        forms: list[tuple[str, str] | None] = []
        base: dict[str, bytes | None] = {}
        rest: dict[str, bytes] = {}
        for p in parts:
            if found := _CLEAN.fullmatch(p):
                word, tail = found.groups()
                word = word.lower()
                forms.append((word, tail))
                if word not in base:
                    base[word] = known.new.get(word) or known.old.get(word)
                if tail and tail not in rest:
                    rest[tail] = known.new.get(tail) or known.old.get(tail) or b""
            else:
                forms.append(None)
                rest[p] = b""
        todo = [w for w, ids in base.items() if ids is None]
        if todo:
            joined = self.plain.encode_batch_fast([" ".join(todo)], add_special_tokens=False)[0].ids
            flat = np.array(joined, "<u2" if self.narrow else "<u4")
            cuts = (np.flatnonzero(self.ends[flat]) + 1).tolist()
            if len(cuts) != len(todo) or cuts[-1] != len(flat):
                made = self._library(todo)
            else:
                raw, size = flat.tobytes(), flat.itemsize
                made = [raw[a * size : b * size] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]
            for word, ids in zip(todo, made, strict=True):
                base[word] = ids
                known.put(word, ids)
        unknown = [p for p, ids in rest.items() if not ids]
        if unknown:
            for p, ids in zip(unknown, self._library(unknown), strict=True):
                rest[p] = ids
                known.put(p, ids)
        return [rest[p] if f is None else base[f[0]] + rest[f[1]] if f[1] else base[f[0]] for p, f in zip(parts, forms, strict=True)]

    def _count(self, parts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    @property
    def narrow(self) -> bool:
        """Whether an id fits 16 bits."""
        return self.tokenizer.get_vocab_size() <= 1 << 16

    def pack_texts(self, texts: list[str | None], together: int = 100_000) -> list[bytes]:
        """The ids of each text; pre-tokens of many texts are looked up together."""
        out: list[bytes] = []
        held: list[str] = []
        ends = [0]

        def flush() -> None:
            packed = self.pack_all(held)
            out.extend(b"".join(packed[a:b]) for a, b in zip(ends, ends[1:], strict=False))
            held.clear()
            ends[1:] = []

        for x in texts:
            held += self.pretokens(x or "")
            ends.append(len(held))
            if len(held) >= together:
                flush()
        flush()
        return out

    def count_all(self, parts: list[str]) -> list[int]:
        """Pieces of each pre-token; each distinct one is counted once while the cache holds it."""
        return self.counts.all(parts, self._count)

    def pack_all(self, parts: list[str]) -> list[bytes]:
        """Ids of each pre-token, little-endian, of 16 bits where they fit and 32 elsewhere."""
        return self.packed.all(parts, self._packs)
