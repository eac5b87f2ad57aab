"""Many names in one text: an automaton finds all of them in one pass, borders and what follows are looked at where one stands."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick

LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")
#: What makes a name an assignment's, what is left over of an old one, and what makes it a call.
ASSIGNS, LEFT, CALLS = re.compile(r"\s*[=:/|~]"), re.compile(r"\s*[=:]"), re.compile(r"\s*\(")


class Names:
    """An automaton over a row's names. Empty names stand everywhere, so they are kept apart."""

    def __init__(self, names: Iterable[str]):
        self.names = [n for n in dict.fromkeys(names) if n is not None]
        self.automaton = None
        if filled := [n for n in self.names if n]:
            self.automaton = ahocorasick.Automaton()
            for n in filled:
                self.automaton.add_word(n, n)
            self.automaton.make_automaton()

    def places(self, text: str) -> Iterator[tuple[int, int, str]]:
        """(start, end, name) of all occurrences, overlapping ones too, by their end."""
        if self.automaton is not None:
            for last, name in self.automaton.iter(text):
                yield last + 1 - len(name), last + 1, name
        if "" in self.names:
            yield from ((i, i, "") for i in range(len(text) + 1))

    def present(self, text: str) -> set[str]:
        return {name for _, _, name in self.places(text)}


def alone(text: str, start: int, end: int, also: str = "") -> bool:
    """Whether what stands between two places is a whole word; `also` may not stand before it either."""
    before, after = text[start - 1 : start] if start else "", text[end : end + 1]
    return not (before and (before in LETTERS or before in also)) and not (after and after in LETTERS)


def assigned(text: str | None, names: list[str] | None) -> bool:
    """Whether any of the names stands, quoted or as a whole word, before an assignment mark."""
    for start, end, _ in Names(names or ()).places(text or ""):
        if alone(text, start, end) and ASSIGNS.match(text, end):
            return True
        if start and text[start - 1] in "\"'" and text[end : end + 1] == text[start - 1] and ASSIGNS.match(text, end + 1):
            return True
    return False


def mentioned(text: str | None, names: list[str] | None) -> bool:
    """Whether any of the names is a whole word of the text, in whatever case."""
    low = (text or "").lower()
    return any(alone(low, start, end) for start, end, _ in Names(n.lower() for n in names or () if n is not None).places(low))


def called(text: str | None, names: list[str] | None) -> bool:
    """Whether a text calls any of the named functions."""
    return any(not (start and (text[start - 1] in LETTERS or text[start - 1] == ".")) and CALLS.match(text, end) for start, end, _ in Names(names or ()).places(text or ""))


def first_left(text: str | None, names: list[str] | None) -> str | None:
    """Of the names left at `name=` or `name:` the first in order."""
    return min((n for start, end, n in Names(names or ()).places(text or "") if alone(text, start, end) and LEFT.match(text, end)), default=None)


def renamed(text: str, names: dict[str, str], forms: Iterable[str]) -> str:
    """Old names become new ones, one after the other, the longest first, each in all its forms (patterns with {} for the name).

    Only names that stand in the text are tried, and it is searched again when one was replaced, since what is new may hold another.
    """
    known = Names(names)
    here = known.present(text)
    for old in sorted(names, key=lambda n: -len(n)):
        if old in here:
            before = text
            for form in forms:
                text = re.sub(form.replace("{}", re.escape(old)), lambda _: names[old], text)  # noqa: B023
            if text != before:
                here = known.present(text)
    return text


def before(marks: str) -> tuple[str, str]:
    """Quoted names, then bare ones, before an assignment mark."""
    return rf"""(?<=(["'])){{}}(?=\1\s*{marks})""", rf"(?<![A-Za-z0-9_]){{}}(?![A-Za-z0-9_])(?=\s*{marks})"


#: As the tool has it, and strictly: the wide marks take a path or a pair of alternatives inside a value for an assignment.
ASSIGNMENTS, STRICT_ASSIGNMENTS = before("[=:/|~]"), before("[=:](?![/])")
#: Names before a parenthesis.
CALL_HEADS = (r"(?<![A-Za-z0-9_.]){}(?=\s*\()",)
