"""Words of a question. The question is a short text, so this runs where it is asked."""

from __future__ import annotations

import re

# Words that carry nothing in a search.
STOP_WORDS = frozenset(
    "the a an and or but in on at to for of with by from is it that this are was be has had have do does did will would could should may might can "
    "shall not no all each every how what where when who which why i me my we our you your he she they show give tell been done made used using work works "
    "found also into then than just more some such over only out its so up as if look need needs want happen happens affect affected break breaks failing "
    "implemented implement code file files function method class type fix bug called".split()
)
_BOUNDARY = re.compile(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
# Fixed values: (ending, least length of the word, letters to drop, what to add); a doubled last letter is also halved for the marked ones.
_ENDINGS = (("ing", 6, 3, ("", "e"), True), ("tion", 6, 3, ("",), False), ("sion", 6, 3, ("",), False), ("ment", 7, 4, ("",), False), ("er", 5, 2, ("", "e"), True))


def stems(term: str) -> list[str]:
    """Shorter forms of a word, sorted; three letters or more each."""
    t, out = term.lower(), set()
    for ending, least, drop, adds, halve in _ENDINGS:
        if t.endswith(ending) and len(t) >= least:
            base = t[:-drop]
            out |= {base + a for a in adds}
            if halve and base[-1:] == base[-2:-1]:
                out.add(base[:-1])
    if len(t) > 4:
        if t.endswith("ies"):
            out.add(t[:-3] + "y")
        elif t.endswith("es"):
            out.add(t[:-2])
        elif t.endswith("s") and not t.endswith("ss"):
            out.add(t[:-1])
        if t.endswith("ed") and not t.endswith("eed"):
            out |= {t[:-1], t[:-2]}
            if t.endswith("ied") and len(t) > 5:
                out.add(t[:-3] + "y")
    return sorted(x for x in out if len(x) >= 3 and x != t)


def search_terms(query: str, stems: bool = True) -> list[str]:
    """Compounds, their parts and other words of a question, then stems; each once, in order of appearance."""
    compounds = [w for w in re.findall(r"[A-Za-z0-9]+", query) if len(w) >= 3 and w[0].isalpha() and re.search("[a-z][A-Z]", w)]
    snakes = [w for w in re.split(r"[\s()\[\]{}.,;:\"']+", query) if len(w) >= 3 and "_" in w and re.fullmatch(r"\w+", w, re.A)]
    parts = [w for w in re.split(r"[^A-Za-z0-9]+", _BOUNDARY.sub(" ", query)) if len(w) >= 3 and w.lower() not in STOP_WORDS]
    found = list(dict.fromkeys(w.lower() for w in (*compounds, *snakes, *parts)))
    if stems:
        found += [v for v in dict.fromkeys(v for w in found for v in globals()["stems"](w)) if v not in found and v not in STOP_WORDS]
    return found


def match_terms(query: str) -> list[str]:
    """The prefixes that a ranked search looks for."""
    words = (re.sub(r"['\"*():^]", "", w) for w in query.replace("::", " ").split())
    return [w for w in words if w and w.upper() not in ("AND", "OR", "NOT", "NEAR")]
