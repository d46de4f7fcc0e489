"""License scans by conditional compression.

Notices may run over lines, stand inside longer sentences or behind comment marks, so blocks are
windows of a text's words around the words that identify a template.  The part of a window that
fits the template best is confirmed if it lacks few of the template's words; words around it do not
count.  It is then compressed alone and with the template as a raw zstandard dictionary, and of the
templates that claim the same words the one that saves most is reported.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import small, utf8
from trendloom.llm.license_texts import TEMPLATES

# Words that every notice has one of.
CUE = re.compile(
    rb"(?i)licen[cs]e|public\s+domain|permission\s+(?:to\s+use|is\s+hereby)|redistribution\s+and\s+use|creative\s+commons|\bcc0\b"
    rb"|waived\s+all|redistributions|\b(?:released|distributed)\s+under\b|gpl"
)
# Parts of them, which a text is searched for first: much faster than the pattern.
HINTS = (b"licens", b"licenc", b"public", b"permission", b"redistribution", b"creative", b"cc0", b"waived", b"released", b"distributed", b"gpl")
MAX_DIFFERENT = 0.25  # missing words, of the words of the template
SPDX = "spdx-license-identifier"
_WORD = re.compile(r"[a-z0-9][a-z0-9.+-]*[a-z0-9]|[a-z0-9]")
_STOP = re.compile(r"[.!?]\s")  # where many other words stand between, the part is one sentence
_MARKED = re.compile(r"\{([^{}]*)\}")


def wording(text: str) -> list[str]:
    return [w.replace("licence", "license") for w in _WORD.findall(text.lower())]


@dataclass(frozen=True)
class Form:
    """One wording of a licence; ``keys`` are the positions of the words that must be there."""

    name: str
    text: str
    words: tuple[str, ...]
    keys: frozenset[int]

    @classmethod
    def of(cls, name: str, marked: str) -> Form:
        words, keys, at = [], set(), 0
        for m in _MARKED.finditer(marked):
            words += wording(marked[at:m.start()])
            own = wording(m[1])
            keys.update(range(len(words), len(words) + len(own)))
            words += own
            at = m.end()
        words += wording(marked[at:])
        return cls(name, _MARKED.sub(r"\1", marked), tuple(words), frozenset(keys))

    @property
    def limit(self) -> int:
        return int(MAX_DIFFERENT * len(self.words))

    @property
    def between(self) -> int:
        """Other words that may stand between the first and the last key."""
        return len(self.words) // 4

    @property
    def slack(self) -> int:
        """Other words that may stand in a part: a notice may name several licences; two words stand together."""
        return max(8, self.between) if len(self.words) > 3 else self.between

    @property
    def anchors(self) -> list[int]:
        """Positions of words of which a confirmed part has one at least."""
        if self.keys:
            return [max(self.keys, key=lambda i: (len(self.words[i]), -i))]
        ranked = sorted(range(len(self.words)), key=lambda i: (-len(self.words[i]), i))
        return ranked[:self.limit + 1]


def align(form: Form, window: list[str]) -> list[tuple[int, int]]:
    """Pairs (position in the form, in the window) in order that are equal: all keys before as many words
    as can be, on the shortest part of the window."""
    n, scale = len(form.words), len(window) + 1
    weight = [scale * (n + 1 if i in form.keys else 1) for i in range(n)]
    row: list[tuple[int, tuple | None]] = [(0, None)] * (n + 1)
    best = (0, None)
    for j, word in enumerate(window):
        before = row[0]
        for i in range(1, n + 1):
            here = row[i]
            if form.words[i - 1] == word:
                # the later start of equals is the shorter part
                value = before[0] + weight[i - 1] + (0 if before[1] else j)
                if value > here[0]:
                    row[i] = (value, (before[1], i - 1, j))
            if row[i - 1][0] > row[i][0]:
                row[i] = row[i - 1]
            before = here
        if row[n][0] > best[0]:
            best = row[n]
    pairs, link = [], best[1]
    while link:
        pairs.append((link[1], link[2]))
        link = link[0]
    return pairs[::-1]


class Scanner:
    def __init__(self, templates: dict[str, str | list[str]]):
        self.plain = zstandard.ZstdCompressor(level=3)
        self.anchors: dict[str, list[tuple[Form, int]]] = {}
        self.spdx: dict[str, Form] = {}
        for name, forms in templates.items():
            unique = {f.words: f for f in (Form.of(name, t) for t in ([forms] if isinstance(forms, str) else forms)) if f.words}
            for form in unique.values():
                for at in form.anchors:
                    self.anchors.setdefault(form.words[at], []).append((form, at))
            for end in ("", "-only", "-or-later"):
                self.spdx[f"{name}{end}".lower()] = Form.of(name, f"SPDX-License-Identifier: {{{name}{end}}}")
        self.known: dict[tuple, tuple[int, int]] = {}
        self.aligned: dict[tuple, list[tuple[int, int]]] = {}

    def fit(self, form: Form, window: list[str]) -> list[tuple[int, int]] | None:
        """Pairs of the confirmed part of a window, or None."""
        have = Counter(window)
        if any(form.words[i] not in have for i in form.keys):
            return None
        if sum((Counter(form.words) - have).values()) > form.limit:
            return None
        at = (form.words, tuple(window))
        if at not in self.aligned:
            if len(self.aligned) >= 2_000:
                self.aligned = {}
            self.aligned[at] = align(form, window)
        pairs = self.aligned[at]
        if len(form.words) - len(pairs) > form.limit or pairs[-1][1] - pairs[0][1] >= len(form.words) + form.slack:
            return None
        keys = [(i, j) for i, j in pairs if i in form.keys]
        if len(keys) < len(form.keys) or keys and keys[-1][1] - keys[0][1] > keys[-1][0] - keys[0][0] + form.between:
            return None
        return pairs

    def sizes(self, form: Form, part: str) -> tuple[int, int]:
        """Bytes of a part compressed alone and with the form."""
        at = (form.words, part)
        if at not in self.known:
            if len(self.known) >= 20_000:
                self.known = {}
            raw = part.encode()
            primed = zstandard.ZstdCompressionDict(form.text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.known[at] = len(self.plain.compress(raw)), len(zstandard.ZstdCompressor(level=3, dict_data=primed).compress(raw))
        return self.known[at]

    def parts(self, words: list[str], lines: list[int]) -> Iterator[tuple[Form, list[tuple[int, int]]]]:
        """Confirmed parts: a form and the pairs (position in the form, in ``words``)."""
        seen = set()
        for p, word in enumerate(words):
            if word == SPDX:
                q = p + 1  # every licence of the expression
                while q < len(words) and lines[q] == lines[p]:
                    if words[q] in self.spdx:
                        yield self.spdx[words[q]], [(0, p), (1, q)]
                    elif words[q] in self.anchors and words[q - 1] not in ("and", "or", "with", SPDX):
                        break
                    q += 1
            for form, at in self.anchors.get(word, ()):
                n, start = len(form.words), p - at
                if start >= 0 and tuple(words[start:start + n]) == form.words:
                    pairs = [(i, start + i) for i in range(n)]
                else:
                    low, high = max(0, start - form.slack), max(0, start + n + form.slack)
                    window = words[low:high]
                    pairs = self.fit(form, window)
                    if pairs is None:
                        continue
                    pairs = [(i, low + j) for i, j in pairs]
                if (at := (form.name, form.words, pairs[0][1], pairs[-1][1])) not in seen:
                    seen.add(at)
                    yield form, pairs

    def scan(self, text: bytes) -> list[tuple]:
        """(line, template, plain size, size with it, missing words, exact), once per line and template."""
        small_letters = text.lower()
        if not any(h in small_letters for h in HINTS) or not CUE.search(text):
            return []
        lowered = text.decode("utf-8", "replace").lower()
        words, lines, spans, line, last = [], [], [], 0, 0
        for m in _WORD.finditer(lowered):
            line += lowered.count("\n", last, m.start())
            last = m.start()
            words.append(m[0].replace("licence", "license"))
            lines.append(line)
            spans.append(m.span())
        found = []
        for form, pairs in self.parts(words, lines):
            first, end = pairs[0][1], pairs[-1][1]
            if form.text.startswith("SPDX-"):
                part = form.text.lower()
            else:
                part = lowered[spans[first][0]:spans[end][1]]
            gaps = (lowered[spans[j][1]:spans[k][0]] for (_, j), (_, k) in zip(pairs, pairs[1:]) if k > j + 1)
            if end - first >= len(form.words) + form.between and not form.text.startswith("SPDX-") and any(map(_STOP.search, gaps)):
                continue
            alone, size = self.sizes(form, part)
            if size >= alone:
                continue
            lacking = len(form.words) - len(pairs)
            exact = lacking == 0 and (end - first + 1 == len(form.words) or form.text.startswith("SPDX-"))
            own = {j for i, j in pairs if i in form.keys} or {j for _, j in pairs}
            found.append((size - alone, lacking, form.name, alone, size, exact, lines[first], own, bool(form.keys), {j for _, j in pairs}))
        found.sort(key=lambda f: (f[0] + 2 * f[1], f[1], not f[5], f[2], f[6]))
        best: dict[tuple[int, str], tuple] = {}
        by_word: dict[int, list[int]] = {}
        for number, (_, lacking, name, alone, size, exact, line, own, keyed, all_words) in enumerate(found):
            # claimed: one better part has all words that identify this one (without such words: most of its words)
            shares = Counter(n for j in own for n in by_word.get(j, ()))
            if shares and max(shares.values()) >= (len(own) if keyed else len(own) / 2):
                continue
            for j in all_words:
                by_word.setdefault(j, []).append(number)
            if (line, name) not in best or lacking < best[line, name][2]:
                best[line, name] = alone, size, lacking, exact
        return [(line, name, *facts) for (line, name), facts in sorted(best.items())]


COLUMNS = ("line", "license", "plain_bytes", "conditional_bytes", "different_words", "exact")


def scan_licenses(df: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str | list[str]] | None = None) -> DataFrame:
    """(key, line, license, plain_bytes, conditional_bytes, different_words, exact) per notice found.

    Rows of ``df`` without a notice, with an empty or a null text give no row; a notice repeated on
    several lines gives a row each.  ``line`` is the line in which it begins, ``different_words`` the
    words of the template that it lacks; ``exact`` notices lack none and have no other words between.
    """
    templates = templates or TEMPLATES
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]):
        scanner = Scanner(templates)
        for batch in small(batches):
            rows = [
                (i, *hit) for i, t in zip(batch.column(0).to_pylist(), utf8(batch.column(1))) for hit in scanner.scan(t)
            ]
            if rows:
                ids, *rest = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, batch.column(0).type), *(pa.array(c) for c in rest)], names=["id", *COLUMNS]
                )

    found = df.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(
        run,
        f"id {kind.simpleString()}, line long, license string, plain_bytes long, conditional_bytes long, "
        "different_words long, exact boolean",
    )
    return found.select(F.col("id").alias(key), *COLUMNS)
