"""Reading names of people and firms as typed: the kernels that spelling variants and record
linkage share. Plain functions on strings; the operators call them on distinct values only."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

from quillmark.llm.mojibake import CODE_PAGES, LOST, REVERSE

#: Short forms of given names.
NICKNAMES = {
    "alexander": "alex al sasha xander", "alexandra": "alex sandra", "andrew": "andy drew", "anthony": "tony ant", "barbara": "barb babs barbie", "benjamin": "ben benny benji", "charles": "charlie chuck chas", "christine": "chris tina chrissy christy",
    "christopher": "chris kit topher", "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie", "donald": "don donnie", "dorothy": "dot dottie", "edward": "ed eddie ted ned", "elizabeth": "liz beth betty lizzie eliza betsy libby", "eugene": "gene", "frederick": "fred freddie freddy rick",
    "gerald": "gerry jerry", "gregory": "greg", "harold": "harry hal", "helena": "lena", "henry": "hank harry", "jacqueline": "jackie jacqui", "james": "jim jimmy jamie", "jeffrey": "jeff", "jennifer": "jen jenny", "jessica": "jess jessie", "john": "jack johnny jon", "jonathan": "jon jonny nathan",
    "joseph": "joe joey", "joshua": "josh", "judith": "judy", "katherine": "kate kathy katie kat kay", "kenneth": "ken kenny", "lawrence": "larry", "leonard": "leo len lenny", "margaret": "maggie meg peggy marge", "martin": "marty", "matthew": "matt", "michael": "mike mick mickey", "nancy": "nan",
    "nathaniel": "nate nathan", "nicholas": "nick nicky", "pamela": "pam", "patricia": "pat patty trish", "patrick": "pat paddy", "peter": "pete", "philip": "phil", "raymond": "ray", "rebecca": "becky becca", "richard": "rick dick rich richie", "robert": "bob rob bobby robbie", "ronald": "ron ronnie",
    "samuel": "sam sammy", "sandra": "sandy", "stephen": "steve", "steven": "steve stevie", "susan": "sue susie", "theodore": "ted theo teddy", "thomas": "tom tommy", "timothy": "tim timmy", "victoria": "vicky", "viktor": "vik", "virginia": "ginny ginger", "walter": "walt", "william": "bill will billy willy liam",
}
FORMAL: dict[str, frozenset[str]] = {}
for _name, _short in NICKNAMES.items():
    for _n in (_name, *_short.split()):
        FORMAL[_n] = FORMAL.get(_n, frozenset()) | {_name}
#: Given names so usual that two of them are never slips of one another.
USUAL = frozenset("""maria marta martha mario marie mara anna anne ana agnes amara andrea andreas andrew andre anneke alexander alexandra
barbara bjorn carl carla karl karla charles chloe claire david daniel daniela denis dennis dimitri edward edgar erik eric fatima francois frederick gunther
gregory hans helen helena elena henrik hugo ingrid ines james jan jane jean joan john johan johanna jonathan jose josef joseph juan julia julian juliana jurgen kenji
kenneth lars laura leila lena lisa lucas lucia luca luis lukasz magnus margaret mark marc martin martina matthew matthias mei michael michaela nicholas nicole noemie norbert olga oskar
patricia patrick paul paula pavel peter petra priya rafael rebecca richard robert roberta ronald samuel simon simone sofia soren stefan steven susan theodore thomas timothy tobias viktor viktoria
victor victoria virginia william yusuf zoe""".split())
#: What stands around a name without being part of it.
TITLES = frozenset("dr prof professor mr mrs ms miss sir dame lord hon rev ing dipl".split())
DEGREES = re.compile(r"(?i)(?<![\w.])(?:c\.?f\.?a|c\.?p\.?a|m\.?b\.?a|ph\.? ?d|j\.d|esq|m\.d|c\.?a|o\.?b\.?e|k\.?b\.?e|c\.?b\.?e|m\.?sc|b\.?sc|ll\.?[bm]|f\.?c\.?a)\.?(?![\w.])")
GENERATION = re.compile(r"(?i)[, ]+(jr|sr|ii|iii|iv)\.?$")
#: Legal forms and their other spellings.
LEGAL = {
    "inc": "inc", "incorporated": "inc", "co": "co", "company": "co", "corp": "corp", "corporation": "corp", "ltd": "ltd", "limited": "ltd", "plc": "plc", "llc": "llc", "lp": "lp", "llp": "llp", "ag": "ag", "sa": "sa", "se": "se", "nv": "nv", "gmbh": "gmbh",
}
LETTERS = str.maketrans({"ø": "o", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe", "đ": "d", "ð": "d", "þ": "th"})


def unscrambled(text: str) -> str:
    """UTF-8 that was read sign by sign, read again; up to twice."""
    for _ in range(2):
        if text.isascii():
            return text
        for page in CODE_PAGES:
            back = REVERSE[page]
            if all(c < "\x80" or c in back for c in text):
                try:
                    text = bytes(ord(c) if c < "\x80" else back[c] for c in text).decode("utf-8")
                    break
                except UnicodeDecodeError:
                    continue
        else:
            return text
    return text


@lru_cache(maxsize=200_000)
def fold(text: str) -> str:
    """Small letters without marks."""
    text = unicodedata.normalize("NFKD", unscrambled(text)).casefold().translate(LETTERS)
    return "".join(c for c in text if not unicodedata.combining(c))


@dataclass(frozen=True)
class Person:
    given: tuple[str, ...]  # first and further given names or initials
    surname: str
    generation: str = ""

    @property
    def key(self) -> str:
        return f"{' '.join(self.given)}|{self.surname}|{self.generation}"


def _tokens(text: str) -> list[str]:
    return [t for t in re.findall(rf"[\w{LOST}'’]+(?:-[\w{LOST}]+)*", text.replace(".", " ")) if t != "'"]


def person(name: str, given_names: frozenset[str] = frozenset()) -> Person | None:
    """Titles and degrees are let aside. The surname stands before a comma, or first in capitals, or
    first if the last word is a given name and the first is none; else last."""
    text = unscrambled(name).strip()
    generation = ""
    if m := GENERATION.search(text):
        generation, text = m[1].casefold(), text[: m.start()]
    text = DEGREES.sub(" ", text).strip(" ,;-")
    head, comma, tail = text.partition(",")
    first, rest = _tokens(head), _tokens(tail) if comma else []
    first = [t for k, t in enumerate(first) if fold(t) not in TITLES or len(first) == 1]
    rest = [t for t in rest if fold(t) not in TITLES]
    if rest:
        return _made(rest, " ".join(first), generation)
    if not first:
        return None
    if len(first) == 1:
        return Person((), fold(first[0]), generation)
    caps = [len(t) > 2 and t.isupper() for t in first]
    if caps[0] and not any(caps[1:]):
        return _made(first[1:], first[0], generation)
    if caps[-1] and not any(caps[:-1]):
        return _made(first[:-1], first[-1], generation)
    known = [fold(t) in given_names or fold(t) in FORMAL for t in first]
    if known[-1] and not known[0] and len(first[0]) > 1:
        return _made(first[1:], first[0], generation)
    if len(first[-1]) == 1 and len(first[0]) > 1 and len(first) > 1 and all(len(t) == 1 for t in first[1:]):
        return _made(first[1:], first[0], generation)
    return _made(first[:-1], first[-1], generation)


def _made(given: list[str], surname: str, generation: str) -> Person:
    return Person(tuple(fold(t) for t in given if t), fold(surname).strip(), generation)


def distance(a: str, b: str, most: int = 2) -> int:
    """Edits incl. swaps of neighbours; a lost sign equals any; ``most + 1`` if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y and LOST not in (x, y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


def same_given(a: str, b: str, common: frozenset[str] = frozenset()) -> int:
    """3 equal, 2 short form or initial, 1 mistyped, 0 another name. Two given names that both
    occur often, or of which one is the other with an ending, are different names."""
    if a == b:
        return 2 if len(a) == 1 else 3
    if len(a) == 1 or len(b) == 1:
        one, full = (a, b) if len(a) == 1 else (b, a)
        return 2 if one == full[0] or any(f[0] == one for f in FORMAL.get(full, ())) else 0
    fa, fb = FORMAL.get(a, frozenset({a})), FORMAL.get(b, frozenset({b}))
    if fa & fb:
        return 2
    if a in common | USUAL and b in common | USUAL:
        return 0
    long, short = (a, b) if len(a) > len(b) else (b, a)
    if len(long) > len(short) and long.startswith(short) and long[len(short) :] in ("a", "e", "s", "o", "ne", "na", "ia"):
        return 0
    both_odd = not {a, b} & (common | FORMAL.keys() | USUAL)  # two slips of one name differ by two edits
    if min(len(a), len(b)) >= 3 and distance(a, b, 2) <= (2 if both_odd and min(len(a), len(b)) >= 5 else 1):
        return 1
    # A mistyped short form of the other's full name.
    for x, y in ((a, b), (b, a)):
        if y not in common and y not in FORMAL and len(y) >= 4 and any(distance(s, y, 1) <= 1 for f in FORMAL.get(x, ()) for s in (f, *NICKNAMES[f].split()) if len(s) >= 4):
            return 1
    return 0


def given_level(a: tuple[str, ...], b: tuple[str, ...], common: frozenset[str] = frozenset()) -> int | None:
    """Null where one side has no given name; 0 also if further initials contradict each other."""
    if not a or not b:
        return None
    level = same_given(a[0], b[0], common)
    if level and len(a) > 1 and len(b) > 1 and a[1][0] != b[1][0]:
        return 0
    return level


def near(a: str, b: str) -> int:
    """3 equal, 2 one edit, 1 two edits in a long word, 0 another word."""
    if a == b:
        return 3
    least = min(len(a), len(b))
    if least < 4:
        return 0
    d = distance(a, b, 2)
    return 2 if d <= 1 else 1 if d == 2 and least >= 7 and (a[0] == b[0] or a[:2] == b[1::-1]) else 0


@dataclass(frozen=True)
class Firm:
    core: str
    line: tuple[str, ...]  # what the firm does, such as "industries"
    legal: str

    @property
    def key(self) -> str:
        return f"{self.core}|{' '.join(self.line)}|{self.legal}"


def firm(name: str) -> Firm | None:
    text = fold(name)
    text = re.sub(r"[-\s]+cl(?:ass)?\.? ?[a-d]\b\s*$", "", text)
    text = re.sub(r"\b((?:[a-z]\.){2,})", lambda m: m[1].replace(".", ""), text)
    words = [w.strip("'’") for w in re.findall(rf"[\w{LOST}'’]+", text)]
    words = [w for w in words if w and w not in ("the", "and")]
    legal = ""
    while len(words) > 1 and words[-1] in LEGAL:
        legal = legal or LEGAL[words[-1]]
        words.pop()
    return Firm(words[0], tuple(words[1:]), legal) if words else None


def abbreviates(short: str, long: str) -> bool:
    """``short`` starts like ``long`` and its letters stand in it in order."""
    if len(short) >= len(long) or short[0] != long[0] or len(short) < 2:
        return False
    rest = iter(long)
    return all(c in rest for c in short)


def line_level(a: tuple[str, ...], b: tuple[str, ...]) -> int | None:
    """1 the same line of business (also abbreviated or mistyped), 0 another, null if one is silent."""
    if not a or not b:
        return 1 if a == b else None
    if len(a) != len(b):
        return 1 if a[: len(b)] == b or b[: len(a)] == a else 0
    same = all(x == y or abbreviates(x, y) or abbreviates(y, x) or (min(len(x), len(y)) >= 4 and distance(x, y, 1) <= 1) for x, y in zip(a, b, strict=True))
    return int(same)


def legal_level(a: str, b: str) -> int | None:
    return None if not a or not b else int(a == b)
