"""Reading names of companies and people as they are typed."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

from foliant.llm.edit import within

#: Legal forms and words that go with them, dots and case aside.
LEGAL = frozenset(
    "ltd limited plc public inc incorporated llc llp lp corp corporation co company comp gmbh ag kg sa sarl sas srl spa bv nv oy ab as pty group grp gp the".split()
)
#: Lines of business.
BUSINESS = (
    "agricultural", "automation", "chemicals", "construction", "distribution", "electrical", "engineering", "foundry", "holdings",
    "industries", "instruments", "laboratories", "logistics", "management", "manufacturing", "materials", "packaging",
    "pharmaceuticals", "properties", "refrigeration", "services", "shipping", "technologies", "textiles",
)
#: Plurals, singulars and adjectives that are not their abbreviation.
BUSINESS_ALSO = {"foundries": "foundry", "electric": "electrical", "electronics": "electrical", "agriculture": "agricultural", "labs": "laboratories", "hldg": "holdings"}
#: Places in names, with their short forms.
PLACES = {
    "north": "north", "nth": "north", "n": "north", "northern": "north", "south": "south", "sth": "south", "s": "south", "southern": "south",
    "western": "western", "west": "western", "wstn": "western", "w": "western", "midlands": "midlands", "midland": "midlands", "mids": "midlands",
    "iberia": "iberia", "iberian": "iberia", "ib": "iberia", "nordic": "nordic", "nordics": "nordic", "nord": "nordic",
    "benelux": "benelux", "bnlx": "benelux", "eastern": "eastern", "east": "eastern",
}
#: Forms of address.
TITLES = frozenset("mr mrs ms mx dr prof sir dame miss herr frau".split())
#: Short forms of first names.
SHORT = {
    "robert": "rob bob bobby robbie bert", "alexander": "alex sandy alec xander al", "ignatius": "iggy ig", "thomas": "tom tommy thom",
    "susannah": "sue susie suzie sukie susan", "margaret": "maggie peg peggy meg madge greta", "ottilie": "tilly otti tillie",
    "nathaniel": "nat nate nathan", "hannelore": "lore hanne hanna", "william": "bill will billy willy liam", "frederick": "fred freddie freddy rick",
    "gabrielle": "gaby gabby gabi", "edward": "ed eddie ted ned teddy", "leonard": "leo len lenny lennie", "elizabeth": "liz beth lizzie betty eliza libby",
    "dorothea": "dora dot dottie thea dorothy", "katherine": "kate kathy katie kat kitty", "joseph": "joe jo joey", "veronica": "vera ronnie roni nica",
    "jonathan": "jon jonny johnny john", "theodore": "theo", "richard": "dick richie", "charles": "charlie chuck", "james": "jim jimmy jamie",
    "michael": "mike mick", "christopher": "chris kit", "benjamin": "ben", "samuel": "sam", "daniel": "dan danny", "matthew": "matt",
    "anthony": "tony", "patricia": "pat patty trish", "victoria": "vicky tori", "rebecca": "becky", "deborah": "debbie", "jennifer": "jen jenny",
    "catherine": "cathy", "philip": "phil", "stephen": "steve", "andrew": "andy drew", "nicholas": "nick", "timothy": "tim", "gregory": "greg",
    "abigail": "abby", "josephine": "josie", "penelope": "penny", "barbara": "barb babs", "henry": "harry hank", "peter": "pete", "david": "dave",
}
FIRST = {s: full for full, shorts in SHORT.items() for s in shorts.split()} | {f: f for f in SHORT}
_LOOKALIKE = str.maketrans("0135", "oies")
_CONNECTOR = re.compile(r"[,&+]|\b(?:and|und|et|y)\b")
#: Edit distance within which two spellings of the telling part are one.
RADIUS = 2


class Name(NamedTuple):
    """block: what must be equal (kind, lines of business, place; or first initial). key: the telling part, compared under the metric;
    two stems are in alphabetical order, as people swap them.
    first, middle: a person's first name in full and middle initials; empty where not known."""

    block: str
    key: str
    first: str
    middle: str


def fold(text: str) -> str:
    """Lower case without accents."""
    text = text.replace("ß", "ss").replace("ø", "o").replace("Ø", "O").replace("æ", "ae").replace("ł", "l")
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def _subsequence(short: str, full: str) -> bool:
    it = iter(full)
    return all(c in it for c in short)


@lru_cache(maxsize=100_000)
def business(token: str) -> tuple[str | None, bool]:
    """The line of business a word stands for, and whether it is spelled out (or misspelt) rather than shortened."""
    if token in BUSINESS or token in BUSINESS_ALSO:
        return BUSINESS_ALSO.get(token, token), True
    if token in FIRST or len(token) < 3:
        return None, False
    near = [b for b in BUSINESS if len(token) >= 5 and within(token, b, 1)] or [b for b in BUSINESS if len(token) >= 7 and within(token, b, 2)]
    if near:
        return near[0], True
    # beginnings; contractions that keep the first three letters; contractions without a vowel but the first letter
    fits = [b for b in BUSINESS if len(token) <= 7 and token[0] == b[0] and _subsequence(token, b)]
    short = [b for b in BUSINESS if b.startswith(token)] or [b for b in fits if token[:3] == b[:3]] or [b for b in fits if not set(token[1:]) & set("aeiou")]
    if not short and 5 <= len(token) <= 7:  # a short form that is misspelt itself
        short = [b for b in BUSINESS if token[0] == b[0] and any(len(b) > n and within(token, b[:n], 1) for n in (len(token) - 1, len(token), len(token) + 1))]
    return (short[0], False) if len(short) == 1 else (None, False)


@lru_cache(maxsize=10_000)
def place(token: str, bracketed: bool) -> str | None:
    if token in PLACES and (bracketed or len(token) > 2):
        return PLACES[token]
    full = sorted(set(PLACES.values()))
    if len(token) >= 4:
        near = [p for p in full if within(token, p, 1)] or [p for p in full if bracketed and len(token) >= 6 and within(token, p, 2)]
        if len(near) == 1:
            return near[0]
    return token if bracketed else None


@lru_cache(maxsize=100_000)
def first_name(token: str) -> str:
    """In full, where it is a known name, misspelt or shortened; else as it is."""
    if token in FIRST:
        return FIRST[token]
    near = [f for f in SHORT if len(token) >= 4 and within(token, f, 1)] or [f for f in SHORT if len(token) >= 6 and within(token, f, 2)]
    near = near or [FIRST[s] for s in FIRST if len(s) >= 4 and len(token) >= 4 and within(token, s, 1)]
    return near[0] if near else token


def _tokens(segment: str) -> list[str]:
    out = []
    for t in segment.split():
        t = t.strip(".,;:'\"’").replace("'", "").replace("’", "")
        bare = t.replace(".", "").replace("-", "")
        if bare and any(c.isalnum() for c in bare):
            out.append(bare.translate(_LOOKALIKE) if any(c.isalpha() for c in bare) else bare)
    return out


def _legal(token: str) -> bool:
    return token in LEGAL or (len(token) >= 5 and (within(token, "limited", 1) or within(token, "company", 1) or within(token, "group", 1) or within(token, "incorporated", 2)))


@lru_cache(maxsize=200_000)
def read_name(name: str) -> Name:
    """Parse one name. A name without line of business and legal form is a person's."""
    text = fold(name)
    bracketed = re.findall(r"\(([^()]*)\)", text)
    text = re.sub(r"\([^()]*\)", " ", text)
    segments = [_tokens(s) for s in _CONNECTOR.split(text)]
    segments = [s for s in segments if s]
    words = [t for s in segments for t in s]
    lines = {t: business(t) for t in words if not _legal(t)}
    only_initials = re.search(r",\s*(?:[^\W\d_]\.\s?)+$", text) is not None  # "Name, A.B." is a person, though AB is a legal form
    if (any(_legal(t) and t != "the" for t in words) and not only_initials) or any(b for b, _ in lines.values()) or bracketed:
        stems, trades, places = [], set(), {p for b in bracketed for t in _tokens(b) if (p := place(t, True))}
        for s in segments:
            stem, rest = "", [t for t in s if not _legal(t)]
            # a segment names one line of business; where one is spelled out, or a shortened one follows, a shortened one is a piece of the stem
            said = [i for i, t in enumerate(rest) if lines[t][1]] or [i for i, t in enumerate(rest) if lines[t][0]][-1:]
            broken = [] if said else [i for i in range(len(rest) - 1) if _whole(rest[i] + rest[i + 1])]
            for i, t in enumerate(rest):
                if i in said:
                    trades.add(lines[t][0])
                elif i in broken:
                    trades.add(_whole(t + rest[i + 1]))
                elif i - 1 in broken:
                    continue
                elif p := place(t, len(t) <= 2 and t in PLACES):
                    places.add(p)
                else:
                    stem += t
            if stem:
                stems.append(stem)
        return Name("c:" + "+".join(sorted(trades)) + ":" + "+".join(sorted(places)), " ".join(sorted(stems)), "", "")
    comma = "," in name and len(segments) > 1
    parts = [[t for t in s if t not in TITLES] for s in segments]
    parts = [p for p in parts if p]
    if not parts:
        return Name("p:", "", "", "")
    raw = re.sub(r"\b[^\W\d_]\.(?:\s?[^\W\d_]\.)*", "", text)
    initials = re.findall(r"(?<![^\W_])([^\W\d_])\.", text) or [t for p in parts for t in p if len(t) == 1]
    spelled = [[t for t in _tokens(s) if len(t) > 1 and t not in TITLES] for s in _CONNECTOR.split(raw)]
    spelled = [s for s in spelled if s] or [[]]
    if comma:
        surname = "".join(spelled[0])
        given = spelled[1] if len(spelled) > 1 else []
    else:
        flat = [t for s in spelled for t in s]
        # initials before the only word: the word is the surname, whole or in fragments
        leads = re.match(r"^\W*(?:(?:" + "|".join(TITLES) + r")\.?\s+)?[^\W\d_]\.", text) is not None
        given, surname = ([], "".join(flat)) if leads or len(flat) < 2 else (flat[:1], "".join(flat[1:]))
    if given:
        first, middle = first_name("".join(given[:1])), "".join(initials)
        return Name("p:" + first[:1], surname, first, middle)
    return Name("p:" + "".join(initials[:1]), surname, "", "".join(initials[1:]))


@lru_cache(maxsize=200_000)
def read_text(text: str) -> Name:
    """Anything but a name: one block, letters and digits in lower case without accents, single spaces."""
    return Name("", " ".join("".join(c if c.isalnum() else " " for c in fold(text)).split()), "", "")


def is_name(name: str) -> bool:
    """Whether it reads as the name of a company or, by its first name or form of address, of a person."""
    n = read_name(name)
    return n.block.startswith("c:") or n.first in SHORT or any(t in TITLES for t in _tokens(fold(name)))


@lru_cache(maxsize=100_000)
def _whole(token: str) -> str | None:
    """A line of business spelled in full but for one letter; for words broken by a stray space."""
    return next((b for b in BUSINESS if len(token) >= 7 and within(token, b, 1)), None)


def strip_role(entry: str) -> str:
    """Without the role in the last parentheses, trimmed, runs of white space made one space."""
    return re.sub(r"\s+", " ", re.sub(r"\s*\([^()]*\)\s*$", "", entry)).strip()
