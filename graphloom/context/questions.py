"""What a question in plain words names: symbols, identifiers, and the forms of a word. A question is short, so this runs where it is asked."""

from __future__ import annotations

import re

# Words that are no symbols in a question.
COMMON = frozenset(
    "the and for with from this that have been will would could should does done make made use used using work works find found show call called calling get set add "
    "all any how what when where which who why not but are was were has had its can did may also into than then them each other some such only same about after "
    "before between through during without again further once here there both just more most very being having doing system need needs want wants like look change "
    "changes changed changing layer handle handles handling incoming outgoing data flow flows level levels request requests response responses implement implements "
    "implementation interface interfaces class classes method methods trigger triggers affected affect affects else code failing failed silently decide decides return "
    "returns returned take takes taken check checks checked create creates created read reads write writes written start starts stop stops run runs running".split()
)
# How symbols look, in the order in which they are looked for.
_SHAPES = (
    (re.compile(r"\b([A-Z][a-z]+(?:[A-Z][a-z]*)*|[a-z]+(?:[A-Z][a-z]*)+)\b"), 2),
    (re.compile(r"\b([a-z][a-z0-9]*(?:_[a-z0-9]+)+)\b", re.I), 3),
    (re.compile(r"\b([A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+)\b"), 1),
    (re.compile(r"\b([A-Z]{2,})\b"), 2),
    (re.compile(r"\b([a-zA-Z][a-zA-Z0-9]*(?:\.[a-zA-Z][a-zA-Z0-9]*)+)\b"), 1),
    (re.compile(r"\b([a-z][a-z0-9]{2,})\b"), 3),
)


def symbols_of(question: str) -> list[str]:
    """Likely names in a question: camel, snake and screaming case, acronyms, dotted names with their parts, plain words; each once."""
    found: dict[str, None] = {}
    for shape, least in _SHAPES:
        for m in shape.finditer(question):
            if len(m[1]) >= least:
                found[m[1]] = None
            found |= dict.fromkeys(p for p in m[1].split(".") if "." in m[1] and len(p) >= 2)
    return [s for s in found if s.lower() not in COMMON]


def title(word: str) -> str:
    return word[:1].upper() + word[1:].lower()


def folder(path: str) -> str:
    """What stands before the last slash; a dot if there is none."""
    return path.rpartition("/")[0] if "/" in path else "."


def is_identifier(token: str) -> bool:
    return bool(re.fullmatch(r"[A-Za-z_$][\w$:.]*", token, re.A))


def is_type_name(token: str) -> bool:
    """A capital first, four letters or more, and a small letter among them."""
    return len(token) >= 4 and token[0].isascii() and token[0].isupper() and any(c.isascii() and c.islower() for c in token)


def is_distinctive(token: str) -> bool:
    return bool(re.search(r"[_0-9]|^.+[A-Z]", token))


def about_tests(question: str) -> bool:
    return "test" in question.lower() or "spec" in question.lower()


def identifiers_of(question: str, most: int = 16) -> list[str]:
    """The identifiers that a question spells out, in order; at most ``most``."""
    cut = (t.rstrip("?.,:;") for t in re.split(r"[\s(),\[\]]+", question))
    return list(dict.fromkeys(t for t in cut if len(t) >= 3 and is_identifier(t)))[:most]


def numbered(text: str, first: int) -> str:
    """Lines with their numbers before them."""
    return "\n".join(f"{first + i}\t{x}" for i, x in enumerate(text.split("\n")))


def shortened(text: str, size: int) -> str:
    """At most ``size`` bytes of a text, cut between characters, with a note if something was cut."""
    raw = text.encode()
    return text if len(raw) <= size else raw[:size].decode(errors="ignore") + "\n... (truncated) ..."
