"""Tokenizer workers: whole texts cut where the pre-tokenizer cuts in any context, each distinct piece encoded once.

Between a non-space and a single space before another non-space, a byte-level pre-tokenizer always ends a
pre-token (its only patterns with a space have it in front).  A tokenizer that drops white space ends one at
any ASCII white space.  So pieces between such places are encoded alone, with the same ids.

Most pieces are a word with punctuation around it; of the two known kinds of pre-tokenizers such a piece's pre-tokens are known
without running them: punctuation in front, the word, punctuation behind.  Their ids come from the model itself and are
kept by pre-token, of which there are far fewer than pieces.  All other pieces go through the whole library.  What has not been
asked for lately is forgotten, so a worker holds a bounded number of pre-tokens and pieces."""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import quiet_tokenizers

GENERATION, OTHERS = 160_000, 60_000
MEMO_BYTES = 48
SPACES = "\t\n\x0b\x0c\r\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
IRREGULAR = f"^ | $|[ {SPACES}] | [{SPACES}]|\x01"
SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")
# Letters that composition leaves alone and that have one lower-case form of one letter; punctuation without the apostrophe, which may start a pre-token of its own.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f\u0400-\u0481\u048a-\u052f"
MARKS = "!-&(-/:-@\\[-`{-~"
# How the pre-tokenizers that are known are written in their files.
WITH_SPACE = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
WITHOUT_SPACE = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
FOLDED = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


@lru_cache(maxsize=1)
def byte_letters() -> tuple[dict[int, str], dict[str, int]]:
    """The letters that byte-level vocabularies write bytes as: printable Latin-1 as itself, the rest from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letters = {b: chr(b) for b in shown}
    letters |= {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
    return letters, {c: b for b, c in letters.items()}


@lru_cache(maxsize=4)
def memo(path: str) -> PieceMemo:
    """One for each Python worker and file."""
    return PieceMemo(path)


class Generations:
    """What was asked for lately: a full young generation becomes the old one, and what is asked for again is young again."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get_all(self, words: list[str], make) -> list[bytes]:
        found = list(map(self.young.get, words))
        missing = [i for i, x in enumerate(found) if x is None]
        new = []
        for i in missing:
            x = found[i] = self.old.get(words[i])
            if x is None:
                new.append(i)
        for at in range(0, len(new), 8_000):
            part = new[at : at + 8_000]
            for i, x in zip(part, make([words[i] for i in part]), strict=True):
                found[i] = x
        for i in missing:
            if len(words[i]) <= MEMO_BYTES:
                if len(self.young) >= self.most:
                    self.young, self.old = {}, self.young
                self.young[words[i]] = found[i]
        return found


def gathered(table: np.ndarray, first: np.ndarray, size: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of the table that codes stand for, in a row, and where each starts (and the end)."""
    n = size[codes]
    ends = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(n, out=ends[1:])
    return table[np.arange(ends[-1]) + np.repeat(first[codes] - ends[:-1], n)], ends


class PieceMemo:
    def __init__(self, path: str) -> None:
        quiet_tokenizers()
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.spaced = "ByteLevel" in type(self.library.pre_tokenizer).__name__  # else white space is dropped
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.units, self.others = Generations(GENERATION), Generations(OTHERS)
        self.letters = {b: c for b, c in byte_letters()[0].items() if c != chr(b)}
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        cutter, folding = said["pre_tokenizer"] or {}, said["normalizer"]
        self.form, self.folds = None, False
        if cutter == WITH_SPACE and folding is None:
            self.form = f"^(?P<a>(?: ?[{MARKS}]+)?)(?P<w> ?(?:[{LETTERS}]+|[0-9]+)?)(?P<z>[{MARKS}]*)$"
        elif cutter.get("pretokenizers") == [WITHOUT_SPACE, WITH_SPACE | {"use_regex": False}] and (folding or {}).get("normalizers") == FOLDED:
            self.form, self.folds = f"^(?P<a>[{MARKS}]*)(?P<w>[{LETTERS}]*|[0-9])(?P<z>[{MARKS}]*)$", True

    def pieces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All pieces of the texts, and for each text the place of its first one (and the end)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.spaced:
            cut = pc.ascii_split_whitespace(texts)
            return cut.flatten(), cut.offsets.to_numpy()
        odd = pc.match_substring_regex(texts, IRREGULAR)
        cut = pc.split_pattern(pc.replace_substring(texts, " ", "\x01 "), "\x01")
        if pc.any(odd).as_py():
            lists = cut.to_pylist()
            for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
                lists[i] = SAFE_CUT.split(texts[int(i)].as_py())
            cut = pa.array(lists, pa.large_list(pa.large_string()))
        return cut.flatten(), cut.offsets.to_numpy()

    def distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each piece its code; the ids of all codes in a row, int32; where those of each code start, and how many they are."""
        coded = pieces.dictionary_encode()
        words = coded.dictionary
        if self.form is None or not len(words):
            plain = np.zeros(len(words), bool)
        else:
            parts = pc.extract_regex(words, self.form)
            plain = parts.is_valid().to_numpy(zero_copy_only=False)
            for token in self.added:
                plain &= ~pc.match_substring(words, token).to_numpy(zero_copy_only=False)
        known, codes = [], np.zeros((3, len(words)), np.int64)  # 0 is the pre-token without ids
        if plain.any():
            a, w, z = (parts.filter(pa.array(plain)).field(k).cast(pa.large_string()) for k in "awz")
            units = pa.concat_arrays([a, pc.utf8_lower(w) if self.folds else w, z]).dictionary_encode()
            known = self.units.get_all(units.dictionary.to_pylist(), self.tokens_of)
            codes[:, plain] = units.indices.to_numpy().reshape(3, -1) + 1
        rest = np.flatnonzero(~plain)
        codes[0, rest] = np.arange(len(rest)) + len(known) + 1
        known = [b"", *known, *self.others.get_all(words.take(pa.array(rest)).to_pylist(), self.encode_alone)]
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        table, ends = gathered(np.frombuffer(b"".join(known), np.int32), np.cumsum(size) - size, size, codes.T.ravel())
        bounds = ends[::3]
        return coded.indices.to_numpy(), table, bounds[:-1], np.diff(bounds)

    def tokens_of(self, units: list[str]) -> list[bytes]:
        """Ids of pre-tokens, from the model alone."""
        tokenize, letters = self.library.model.tokenize, self.letters
        written = (u.replace(" ", letters[32]) if u.isascii() else u.encode().decode("latin-1").translate(letters) for u in units)
        return [array("i", [t.id for t in tokenize(u)]).tobytes() if u else b"" for u in written]

    def encode_alone(self, words: list[str]) -> list[bytes]:
        return [array("i", x.ids).tobytes() for x in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def counts(self, texts: pa.Array) -> np.ndarray:
        pieces, starts = self.pieces(texts)
        codes, _, _, size = self.distinct(pieces)
        total = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(size[codes], out=total[1:])
        return np.diff(total[starts])

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, int32, and for each text where its ids start (and the end)."""
        pieces, starts = self.pieces(texts)
        codes, table, first, size = self.distinct(pieces)
        ids, ends = gathered(table, first, size, codes)
        return ids, ends[starts]
