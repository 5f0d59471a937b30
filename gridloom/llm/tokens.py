"""Token ids of whole texts with the word-level BPE file, word by word through bounded caches."""

from __future__ import annotations

import os
import re

import numpy as np

from .common import CACHES

#: Words that one worker remembers in each of two generations, and parts of words likewise.
REMEMBERED = 200_000
#: Texts with these are encoded whole: Python's split and the tokenizer's white space differ on them.
_ODD = re.compile("[\x1c-\x1f\x85]")
#: Words of these only fall into parts the way the tokenizer's own rule splits them, and lower case is the same for both.
_PLAIN = re.compile("[!-&(-~À-ÖØ-öø-ÿ]+")
_PLAIN_TEXT = re.compile("[\t-\r -&(-~À-ÖØ-öø-ÿ]*")
_PART = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


class Recent:
    """A cache of bounded size: what was not asked for during a whole generation goes."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def missing(self, keys) -> list[str]:
        young, old = self.young, self.old
        for k in (absent := [k for k in keys if k not in young]):
            if k in old:
                young[k] = old[k]
        return [k for k in dict.fromkeys(absent) if k not in young]

    def turn(self) -> None:
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokens:
    """Encodes texts to the little-endian unsigned 32-bit ids that the tokenizer gives, without adding special tokens.

    The tokenizer drops white space and never joins what it separates, so a text's ids are
    its words' ids one after the other. A special token that stands in a text is one id, as
    the tokenizer has it, and parts the text before any other rule.
    """

    _open: dict[str, WordTokens] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.path, self._full = path, None
        special = {t.content: i for i, t in Tokenizer.from_file(path).get_added_tokens_decoder().items()}
        self.special = {t: np.array([i], "<u4").tobytes() for t, i in special.items()}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        # parts are in lower case and split already: white space is all that separates them
        self.lean = Tokenizer.from_file(path)
        self.lean.encode_special_tokens = True
        self.lean.normalizer = normalizers.Sequence([])
        self.lean.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.words, self.parts = Recent(REMEMBERED), Recent(REMEMBERED)
        last = [i for t, i in self.lean.get_vocab().items() if t.endswith("</w>")]
        self.ends = np.zeros(max(self.lean.get_vocab().values()) + 1, bool)
        self.ends[last] = True

    @property
    def tokenizer(self):
        """The tokenizer as it is in the file; texts of plain words never need it."""
        if self._full is None:
            from tokenizers import Tokenizer

            self._full = Tokenizer.from_file(self.path)
        return self._full

    @classmethod
    def at(cls, path: str) -> WordTokens:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, missing: list[str], plain: bool) -> None:
        """Missing words: plain ones part by part, all new parts in one call; a part's last token ends a word."""
        split = {w: _PART.findall(w) for w in missing} if plain else {w: _PART.findall(w.lower()) for w in missing if _PLAIN.fullmatch(w)}
        need = self.parts.missing(p for ps in split.values() for p in ps)
        if need:
            ids = np.array(self.lean.encode_batch_fast([" ".join(need)], add_special_tokens=False)[0].ids, "<u4")
            packed, at = ids.tobytes(), 0
            for p, to in zip(need, ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist(), strict=True):
                self.parts.young[p] = packed[at:to]
                at = to
        words, parts = self.words.young, self.parts.young
        for w in missing:
            ps = split.get(w)
            words[w] = self.whole(w) if ps is None else parts[ps[0]] if len(ps) == 1 else b"".join([parts[p] for p in ps])
        self.parts.turn()

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self._special and self._special.search(text):
            return b"".join([self.special.get(t) or self._between(t) for t in self._special.split(text)])
        return self._between(text)

    def _between(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        plain = bool(_PLAIN_TEXT.fullmatch(text))
        if not plain and _ODD.search(text):
            return self.whole(text)
        words = (text.lower() if plain else text).split()
        if missing := self.words.missing(words):
            self._learn(missing, plain)
        known = self.words.young
        out = b"".join([known[w] for w in words])
        self.words.turn()
        return out


CACHES.append(WordTokens._open.clear)
