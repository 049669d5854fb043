"""A source file as tokens, with its brackets matched and its lines indexed; all made once, in linear time."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

from .parsing import mask_comments

_TOKEN = re.compile(
    r"""^[^\S\n]*+(?P<directive>\#[^\n]*)
    |(?P<text>"(?:\\.|[^"\\])*(?:"|\Z)|'(?:\\.|[^'\\])*(?:'|\Z)|`(?:\\.|[^`\\])*(?:`|\Z))
    |(?P<word>[^\W\d]\w*)
    |(?P<mark>=>|&&|\|\||::|\d[\w.]*|\S)""",
    re.M | re.S | re.X,
)
_CLOSERS = {")": "(", "]": "[", "}": "{"}


class Lines:
    """Line numbers of offsets, from 1."""

    def __init__(self, text: str) -> None:
        self.breaks = [m.start() for m in re.finditer("\n", text)]

    def of(self, at: int) -> int:
        return bisect_left(self.breaks, at) + 1


@dataclass
class Part:
    """Consecutive tokens, from ``begin`` up to before ``end``; ``said`` is their text as it stands in the file."""

    begin: int
    end: int
    at: int
    said: str


class Source:
    """Tokens of a C-like text without its comments.

    ``said[i]`` is a token, ``sort[i]`` 'word', 'text' (quoted), 'mark' or 'directive' (a whole
    line from its '#'), ``at[i]`` its offset in the file. ``close[i]`` is the token that closes the
    bracket i, ``open[i]`` the other way; a bracket that has no partner of its kind has no entry.
    """

    def __init__(self, text: str) -> None:
        self.text = mask_comments(text)
        self.lines = Lines(self.text)
        self.said: list[str] = []
        self.sort: list[str] = []
        self.at: list[int] = []
        self.close: dict[int, int] = {}
        self.open: dict[int, int] = {}
        waiting: dict[str, list[int]] = {"(": [], "[": [], "{": []}
        words, sorts, places, n = self.said, self.sort, self.at, 0
        for m in _TOKEN.finditer(self.text):
            sort = m.lastgroup or "mark"
            said = m[sort]
            if sort == "mark":
                if said in waiting:
                    waiting[said].append(n)
                elif said in _CLOSERS and waiting[_CLOSERS[said]]:
                    begin = waiting[_CLOSERS[said]].pop()
                    self.close[begin], self.open[n] = n, begin
            words.append(said)
            sorts.append(sort)
            places.append(m.start(sort))
            n += 1

    def __len__(self) -> int:
        return len(self.said)

    def line(self, i: int) -> int:
        """The line on which token i begins."""
        return self.lines.of(self.at[i])

    def end_of(self, i: int) -> int:
        return self.at[i] + len(self.said[i])

    def span(self, begin: int, end: int) -> str:
        """The text from token ``begin`` to before token ``end``, without white space around it."""
        return self.text[self.at[begin] : self.end_of(end - 1)] if end > begin else ""

    def is_at(self, i: int, *words: str) -> bool:
        """Whether these tokens stand at i."""
        return i >= 0 and self.said[i : i + len(words)] == list(words)

    def words(self, *some: str) -> Iterator[int]:
        """The places of these words."""
        for i, said in enumerate(self.said):
            if said in some and self.sort[i] == "word":
                yield i

    def calls(self, *names: str) -> Iterator[tuple[int, int]]:
        """(name, opening bracket) of each name that has closed round brackets after it."""
        for i in self.words(*names):
            if i + 1 in self.close and self.said[i + 1] == "(":
                yield i, i + 1

    def parts(self, begin: int, end: int, mark: str = ",", holes: dict[int, int] | None = None) -> list[Part]:
        """The tokens from ``begin`` to before ``end`` between marks that lie in no bracket.

        '<' is a bracket only right behind a word, '>' only where such a one is open. ``holes`` are
        stretches (first token to the one behind) that belong to no part; a part ends at one.
        """
        out, first, i, angle = [], begin, begin, 0

        def cut(last: int) -> None:
            out.append(Part(first, last, self.at[first] if last > first else -1, self.span(first, last)))

        while i < end:
            said, skip = self.said[i], (holes or {}).get(i)
            if skip is not None:
                if i > first:
                    cut(i)
                first = i = skip
                continue
            if i in self.close and self.close[i] < end:
                i = self.close[i]
            elif said == "<":
                angle += i > begin and self.sort[i - 1] == "word" and self.end_of(i - 1) == self.at[i]
            elif said == ">":
                angle -= angle > 0
            elif said == mark and not angle:
                cut(i)
                first = i + 1
            i += 1
        cut(end)
        return out
