"""Token ids of many texts with a public tokenizer file, reusing the ids of repeated words.

The vocabulary file's path is a parameter.  Texts are cut at places where the tokenizer always
cuts too.  Arrow cuts many texts at once and numbers their distinct pieces, and the ids of these are
kept in a table of bounded size, so Python and the tokenizer library see a piece once instead of
at every occurrence.
"""

from __future__ import annotations

import os
import string
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from trendloom.llm.common import offsets

ENTRIES = 200_000  # more than these are left for those of the last texts
AT_ONCE = 8 << 20  # bytes of text that a caller should give at a time
HUGE = 256 << 20  # bytes of a text that is not marked inside Arrow, whose texts end at 2 GB
JOINED = 4096  # pieces encoded as one text
# how a byte-level model writes the bytes of a text
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_NAMES = {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(PRINTED)))}
BEHIND_LATIN = "\u0250"
DOTTED = "\u0130"  # in lower case it ends in a combining dot, which is no letter
MARKS = "".join(sorted(set(string.punctuation) - {"'"}))
# no word behind a cut, or white space that is no cut
STRANGE = "^ ?$|[" + "".join(rf"\x{{{c:x}}}" for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n") + "]"


class Cached:
    """Ids as little-endian bytes, two bytes each (vocabularies of fewer than 65,536 entries).

    leading_space: a byte-level vocabulary, in which a word carries the space before it; a single
    space or line feed between two characters that are not white space always starts a new
    piece.  Otherwise white space only ends words and has no ids.
    """

    def __init__(self, path: str, leading_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has its own tasks
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary need more than two bytes")
        self.leading_space = leading_space
        # a separator has one id of its own wherever it stands between two pieces
        self.separator = "\n" if leading_space else " \x01 "
        (self.separator_id,) = self.tokenizer.encode(self.separator, add_special_tokens=False).ids
        self.model = self.tokenizer.model
        probe = ["a", "unusually", "zxqvjk", "\xe9t\xe9", "\xdf\xff\xfc\u0161\u0151"]
        probe += [" " + w for w in probe] if leading_space else []
        # words of Latin letters are one word to every step before the model, which is asked directly then
        self.direct = all(self._word(w) == self._ids(self.tokenizer.encode(w, add_special_tokens=False).ids) for w in probe)
        self.known: dict[str, bytes] = {"": b""}

    @staticmethod
    def _ids(ids: list[int]) -> bytes:
        return array("H", ids).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of Latin letters (lower-case ones without ``leading_space``), with a space in front or not, from the model itself."""
        if word.isascii():
            word = BYTE_NAMES[32] + word[1:] if word[0] == " " else word
        else:
            word = word.encode().decode("latin-1").translate(BYTE_NAMES)
        return self._ids([t.id for t in self.model.tokenize(word)])

    def _call(self, parts: list[str]) -> None:
        """Learn the ids of each part from the tokenizer."""
        plain, odd = [], []
        for p in parts:
            # no white space but a space in front, and no separator
            (plain if p.isprintable() and " " not in p[1:] and p != " " else odd).append(p)
        for at in range(0, len(plain), JOINED):
            part = plain[at:at + JOINED]
            (found,) = self.tokenizer.encode_batch_fast([self.separator.join(part)], add_special_tokens=False)
            ids = np.array(found.ids, "<u2")
            ends = np.flatnonzero(ids == self.separator_id).tolist()
            if len(ends) != len(part) - 1:  # a part holds the separator's id
                odd += part
                continue
            raw = ids.tobytes()
            for x, start, end in zip(part, [0, *(2 * e + 2 for e in ends)], [*(2 * e for e in ends), len(raw)]):
                self.known[x] = raw[start:end]
        for x, found in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)):
            self.known[x] = self._ids(found.ids)

    def _learn(self, parts: list[str]) -> list[bytes]:
        """Ids of distinct parts, new ones from the model or the library."""
        known, wanted = self.known, []
        found = list(map(known.get, parts))
        for k, ids in enumerate(found):
            if ids is not None:
                continue
            p = core = parts[k]
            if p.isascii() or max(p) < BEHIND_LATIN:
                if not self.leading_space:
                    core = p.lower()
                if self.direct and (core[1:] if core[0] == " " else core).isalpha():
                    found[k] = known[p] = self._word(core)
                    continue
            wanted.append(k)
        self._call([parts[k] for k in wanted])
        for k in wanted:
            found[k] = known[parts[k]]
        if len(known) > ENTRIES:
            self.known = {"": b"", **dict(zip(parts, found))}
        return found

    def _distinct(self, pieces: pa.StringArray) -> pa.BinaryArray:
        """Ids of distinct pieces.  A run of marks behind a letter is a word of its own to the tokenizer (but for
        apostrophes), so a piece is cut there, and a word is learned once whatever marks are behind it."""
        if not self.leading_space:
            pieces = pc.if_else(pc.string_is_ascii(pieces), pc.ascii_lower(pieces), pieces)
        core = pc.utf8_rtrim(pieces, MARKS)
        marked = pc.match_substring_regex(core, f"[^\\PL{DOTTED}]$")
        starts, sizes = offsets(pieces), pc.binary_length(pc.if_else(marked, core, pieces)).to_numpy()
        both = np.empty(2 * len(pieces) + 1, np.int32)  # each piece as its word and its marks, in the same bytes
        both[::2], both[1::2] = starts, starts[:-1] + sizes
        parts = pa.StringArray.from_buffers(2 * len(pieces), pa.py_buffer(both), pieces.buffers()[2] or pa.py_buffer(b""))
        parts = parts.dictionary_encode()
        ids = pa.array(self._learn(parts.dictionary.to_pylist()), pa.binary())
        return _joined(ids.take(parts.indices), np.arange(0, 2 * len(pieces) + 1, 2))

    def _put(self, pieces: pa.DictionaryArray, edges: np.ndarray) -> pa.BinaryArray:
        """Ids of the texts whose pieces begin and end at ``edges``."""
        return _joined(self._distinct(pieces.dictionary).take(pieces.indices), edges)

    def _cut(self, texts: pa.StringArray) -> tuple[pa.DictionaryArray, np.ndarray]:
        """Pieces whose ids, put in a row, are the texts' ids (unless white space is irregular), and where each text's begin."""
        if self.leading_space:
            texts = pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n\0")
        else:
            texts = pc.replace_substring(texts, "\n", " ")
        pieces = pc.split_pattern(texts, "\0" if self.leading_space else " ")
        edges = pieces.offsets.to_numpy()
        return pieces.flatten().dictionary_encode(), edges - edges[0]

    @staticmethod
    def _irregular(text: str) -> list[str]:
        """Cut only before single spaces between two characters that are not white space."""
        found: list[str] = []
        for k, word in enumerate(text.split(" ")):
            if not k:
                found.append(word)
            elif word and not word[0].isspace() and found[-1] and not found[-1][-1].isspace():
                found.append(" " + word)
            else:
                found[-1] += " " + word
        return found if found != [""] else []

    def _encode(self, texts: pa.StringArray) -> pa.BinaryArray:
        if not self.leading_space:
            return self._put(*self._cut(texts))
        odd = pc.or_(pc.match_substring(texts, "\0"), pc.greater(pc.binary_length(texts), HUGE)).to_numpy(zero_copy_only=False)
        plain = texts.filter(pa.array(~odd)) if odd.any() else texts
        pieces, edges = self._cut(plain)
        strange = pc.match_substring_regex(pieces.dictionary, STRANGE).to_numpy(zero_copy_only=False)
        if not strange.any() and not odd.any():
            return self._put(pieces, edges)
        before = np.concatenate(([0], np.cumsum(strange[pieces.indices.to_numpy()])))
        odd[~odd] = np.diff(before[edges]) > 0
        cut = [self._irregular(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        by_hand = pa.array([p for parts in cut for p in parts], pa.string()).dictionary_encode()
        ids = self._put(by_hand, np.cumsum([0, *map(len, cut)]))
        plain = self._put(*self._cut(texts.filter(pa.array(~odd))))
        place = np.empty(len(texts), np.int64)
        place[~odd], place[odd] = np.arange(len(plain)), len(plain) + np.arange(len(ids))
        return pa.concat_arrays([plain, ids]).take(pa.array(place))

    def encode_column(self, texts: pa.Array) -> pa.BinaryArray:
        """Ids of each text, all at once; null has none."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        return self._encode(texts) if len(texts) else pa.array([], pa.binary())

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return self.encode_column(pa.array(texts, pa.string())).to_pylist()


def _joined(items: pa.BinaryArray, edges: np.ndarray) -> pa.BinaryArray:
    """Runs of neighbouring items as one item each, in the same bytes."""
    data = items.buffers()[2] or pa.py_buffer(b"")
    return pa.BinaryArray.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets(items)[edges]), data])
