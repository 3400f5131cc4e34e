"""Reading postal addresses whose parts are abbreviated, misplaced or run together."""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

# Postal abbreviations and the states.
STREET_TYPES = {
    "rd": "road rd", "st": "street st str", "ave": "avenue ave av", "ct": "court ct crt", "pkwy": "parkway pkwy pky", "hwy": "highway hwy",
    "ln": "lane ln", "cir": "circle cir circ", "blvd": "boulevard blvd boul", "ter": "terrace ter terr", "dr": "drive dr drv", "pl": "place pl",
    "way": "way wy", "trl": "trail trl", "sq": "square sq", "aly": "alley aly", "loop": "loop", "plz": "plaza plz", "xing": "crossing xing",
}
DIRECTIONS = {"n": "north n", "s": "south s", "e": "east e", "w": "west w", "ne": "northeast ne", "nw": "northwest nw", "se": "southeast se", "sw": "southwest sw"}
UNIT_WORDS = "apartment apt unit suite ste room rm lot space spc floor bldg building"
NAME_WORDS = {"crk": "creek", "spg": "spring", "spgs": "springs", "rdg": "ridge", "hl": "hill", "holw": "hollow", "fld": "field", "gln": "glen", "pk": "park", "bnd": "bend", "mdw": "meadow"}
TOWN_WORDS = {
    "n": "north", "no": "north", "s": "south", "so": "south", "e": "east", "w": "west", "st": "saint", "ste": "sainte", "mt": "mount", "mtn": "mountain",
    "ft": "fort", "lk": "lake", "pt": "point", "prt": "port", "upr": "upper", "ctr": "center", "hts": "heights", "fls": "falls", "cty": "city", "vlg": "village", "spgs": "springs",
}
STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware",
    "DC": "District of Columbia", "FL": "Florida", "GA": "Georgia", "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa",
    "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland", "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota",
    "MS": "Mississippi", "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire", "NJ": "New Jersey",
    "NM": "New Mexico", "NY": "New York", "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon",
    "PA": "Pennsylvania", "RI": "Rhode Island", "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas", "UT": "Utah",
    "VT": "Vermont", "VA": "Virginia", "WA": "Washington", "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming",
}

_TYPE = {w: k for k, v in STREET_TYPES.items() for w in v.split()}
_DIR = {w: k for k, v in DIRECTIONS.items() for w in v.split()}
_STATE = {k.lower(): k for k in STATES} | {re.sub(r"\W", "", v.lower()): k for k, v in STATES.items()}
_STATE_TAIL = re.compile(
    r"(?:^|[\s,])(" + "|".join(sorted((re.escape(v.lower()) for v in STATES.values()), key=len, reverse=True))
    + "|" + "|".join(rf"{k[0]}\.?\s?{k[1]}\.?" for k in map(str.lower, STATES)) + r")[\s,.]*$")
_ZIP_TAIL = re.compile(r"(?:^|[\s,])(\d{4,5})(?:[-\s]?\d{4})?[\s,.]*$")
_BOX = re.compile(r"(?:\bp\.?\s*o\.?\s*|\bpost\s+office\s+|^\s*)(?:box|bx|b)\s*\.?\s*#?\s*(\d+)\b")
_UNIT = re.compile(
    r"(?:\b(?:" + "|".join(UNIT_WORDS.split()) + r")(?:\.|\b)\s*(?:#|no\.?\s*)?\s*|#\s*)(\d+\s?-?[a-z]?|[a-z]\d*)\b"
    r"|\b(?:" + "|".join(UNIT_WORDS.split()) + r")\.?(\d+-?[a-z]?)\b|\b(?:apt|unit|ste|rm|lot)([a-z])(?=[\s,]|$)")
_NUMBER = re.compile(r"^\s*(?:no\.?\s*|#\s*)?(\d+[a-z]?(?:-\d+)?)\s+(?=\S*[a-z])")


class Address(NamedTuple):
    number: str
    direction: str
    street: str
    kind: str
    unit: str
    town: str
    state: str
    zip: str


def _fold(s: str | None) -> str:
    flat = unicodedata.normalize("NFKD", s or "")
    return re.sub(r"\s+", " ", "".join(c for c in flat if not unicodedata.combining(c)).lower()).strip()


def state_code(s: str | None) -> str:
    return _STATE.get(re.sub(r"\W", "", _fold(s)), "")


def zip5(s: str | None) -> str:
    digits = re.sub(r"\D", "", (s or "").split("-")[0].split(" ")[0]) if s else ""
    if len(digits) in (8, 9):
        digits = digits.zfill(9)[:5]
    return digits.zfill(5) if len(digits) in (3, 4, 5) else ""


def town_name(s: str) -> str:
    words = re.findall(r"[a-z]+", s.replace("'", ""))
    if not words:
        return ""
    return " ".join([TOWN_WORDS.get(words[0], words[0])] + [TOWN_WORDS.get(w, w) if w in ("cty", "fls", "hts", "vlg") else w for w in words[1:]])


def _place(text: str) -> tuple[str, str, str]:
    """(town, state, zip) of a text that ends with them."""
    z = st = ""
    if m := _ZIP_TAIL.search(text):
        z, text = zip5(m[1]), text[: m.start()]
    if m := _STATE_TAIL.search(text):
        st, text = state_code(m[1]), text[: m.start()]
    return town_name(text), st, z


def _is_type(w: str) -> str:
    return _TYPE.get(w, "")


def _near_type(w: str) -> str:
    """A street type with one slip, for words of five letters or more."""
    if len(w) < 5:
        return ""
    for full, code in _TYPE.items():
        if len(full) >= 5 and abs(len(full) - len(w)) <= 1 and full[0] == w[0] and sorted(set(full) ^ set(w)) == sorted(set(full) ^ set(w)):
            same = sum(a == b for a, b in zip(full, w)) + sum(a == b for a, b in zip(full[::-1], w[::-1]))
            if same >= len(full) - (len(full) == len(w)) and (sorted(full) == sorted(w) or len(full) != len(w) or same >= 2 * len(full) - 2):
                return code
    return ""


def parse(line: str | None, city: str | None, state: str | None, zipcode: str | None) -> Address:
    """The parts of an address; what the city, state and zip columns lack is looked for at the end of the line
    (or of the city). A post office box has number 'box N' and no street."""
    text = _fold(line)
    text = re.sub(r"\s+-\s+", ", ", text)
    town, st, z = _place(_fold(city))
    st, z = state_code(state) or st, zip5(zipcode) or z
    box = _BOX.search(text)
    unit = number = ""
    tail: list[str] = []
    street = ""
    if box:
        number = f"box {box[1].lstrip('0')}"
        tail = [text[: box.start()], text[box.end():]]
    else:
        if m := _NUMBER.match(text):  # a leading '#12 Name' is the house number, not a unit
            text = f"{m[1]} {text[m.end():]}"
        if m := _UNIT.search(text):
            unit = re.sub(r"\W", "", m[1] or m[2] or m[3]).upper()
            text = f"{text[: m.start()]},{text[m.end():]}"
        for seg in filter(None, (p.strip(" .-") for p in text.split(","))):
            m = _NUMBER.match(seg + (" " if re.fullmatch(r"#?\d+", seg) else ""))
            if m and not number:
                number, street = m[1].lstrip("0"), seg[m.end():]
            else:
                tail.append(seg)
    found = [_place(t) for t in tail if t.strip(" ,.")]
    if len(found) > 1:
        joined = _place(" ".join(t for t in tail if t.strip(" ,.")))
        found = [joined]
    for t2, s2, z2 in found:
        town, st, z = town or t2, st or s2, z or z2
    words = re.findall(r"[a-z0-9]+", street.replace("'", ""))
    direction = kind = ""
    if len(words) > 1 and words[-1] in _DIR:
        direction, words = _DIR[words[-1]], words[:-1]
    if len(words) > 1 and words[0] in _DIR:
        direction, words = direction or _DIR[words[0]], words[1:]
    if len(words) > 1 and (k := _is_type(words[-1]) or _near_type(words[-1])):
        kind, words = k, words[:-1]
    elif len(words) > 2 and not town:  # the town runs on after the street type
        for i in range(len(words) - 2, 0, -1):
            if _is_type(words[i]):
                t2, s2, z2 = _place(" ".join(words[i + 1:]))
                town, st, z, kind, words = t2, st or s2, z or z2, _is_type(words[i]), words[:i]
                break
    return Address(number, direction, " ".join(NAME_WORDS.get(w, w) for w in words), kind, unit, town, st, z)
