"""Reading one stated amount with its unit from a short text."""

from __future__ import annotations

import re
from functools import lru_cache

#: Spellings of each unit code (fixed values); keys are lower case, without dots, single-spaced.
UNIT_SPELLINGS = {
    "usd": ["usd", "us$", "$", "dollar", "dollars", "us dollars"],
    "usd_cent": ["cent", "cents", "¢", "usd cents", "usd cent"],
    "usd_thousand": ["$000", "$000s", "$ 000", "000s", "usd 000"],
    "sq_ft": ["sq ft", "sqft", "sf", "ft²", "ft2", "square feet", "square foot", "sq feet"],
    "sq_yd": ["sq yd", "sy", "square yard", "square yards", "yd²", "yd2", "sq yds"],
    "acre": ["acre", "acres", "ac"],
    "sq_m": ["sq m", "m²", "m2", "square metre", "square metres", "square meter", "square meters", "sqm"],
    "hectare": ["hectare", "hectares", "ha"],
    "sq_mile": ["sq mi", "square mile", "square miles", "mi²", "mi2", "sq mile", "sq miles"],
    "ft": ["ft", "foot", "feet", "lf", "lin ft", "linear feet", "linear foot", "'"],
    "in": ["in", "inch", "inches", '"'],
    "yd": ["yd", "yds", "yard", "yards"],
    "mile": ["mi", "mile", "miles"],
    "m": ["m", "metre", "metres", "meter", "meters"],
    "km": ["km", "kilometre", "kilometres", "kilometer", "kilometers"],
    "lb": ["lb", "lbs", "pound", "pounds"],
    "short_ton": ["ton", "tons", "short ton", "short tons"],
    "kg": ["kg", "kgs", "kilogram", "kilograms"],
    "tonne": ["tonne", "tonnes", "mt", "metric ton", "metric tons"],
    "cwt": ["cwt", "hundredweight", "hundredweights"],
    "gal": ["gal", "gals", "gallon", "gallons"],
    "liter": ["l", "liter", "liters", "litre", "litres"],
    "cu_ft": ["cf", "cu ft", "cubic foot", "cubic feet", "ft³", "ft3"],
    "cu_yd": ["cy", "cu yd", "cubic yard", "cubic yards", "yd³", "yd3"],
    "acre_ft": ["ac-ft", "acre-feet", "acre-foot", "acre feet", "acre foot", "af"],
    "mgal": ["mg", "million gallons", "mgal"],
    "cu_m": ["m³", "m3", "cubic metre", "cubic metres", "cubic meter", "cubic meters", "cu m"],
}
#: Words that scale a sum of money (fixed values).
MONEY_SCALES = {
    "thousand": ["k", "thousand", "thousands", "000", "000s", "th"],
    "million": ["m", "mm", "mil", "mn", "million", "millions"],
    "billion": ["b", "bn", "bil", "billion", "billions"],
}
#: Number words (fixed values).
_UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
WORDS = {w: i for i, w in enumerate(_UNITS)} | {w: 20 + 10 * i for i, w in enumerate(_TENS)}
MULTIPLIERS = {"thousand": 10**3, "million": 10**6, "billion": 10**9}
FRACTIONS = {"¼": 0.25, "½": 0.5, "¾": 0.75, "⅓": 1 / 3, "⅔": 2 / 3, "⅛": 0.125, "⅜": 0.375, "⅝": 0.625, "⅞": 0.875}

_CODE = {s: code for code, names in UNIT_SPELLINGS.items() for s in [code, *names]}
_SCALE = {s: scale for scale, names in MONEY_SCALES.items() for s in names}
_MONEY_WORD = r"(?:us\s?\$|\$|(?<![a-z])(?:usd|dollars?)(?![a-z]))"
_NUMBER = r"(?:\d{1,3}(?:\s?,\s?\d{3})+|\d{1,3}(?: \d{3})+|\d+)?(?:\.\d+)?"
_AMOUNT = re.compile(rf"(?P<cur>us\s?\$|\$|usd)?\s*(?P<num>{_NUMBER})(?:\s?(?P<vul>[{''.join(FRACTIONS)}])|[ -](?P<top>\d+)/(?P<bottom>\d+))?\s*(?P<rest>[^\d].*)?")
_LENGTH = re.compile(r"(\d+(?:,\d{3})*)\s*(?:'|ft\.?|feet|foot)\s*-?\s*(\d+(?:\.\d+)?)\s*(?:\"|in\.?|inches|inch)")
_WORDED = re.compile(rf"((?:(?:{'|'.join(sorted([*WORDS, *MULTIPLIERS], key=len, reverse=True))}|hundred|and)[ -]?)+)(?<=[a-z -])\s*(.*)")


def _tidy(text: str) -> str:
    return re.sub(r"\s+", " ", re.sub("[    ]", " ", text)).strip().casefold()


@lru_cache(maxsize=4096)
def unit_of(text: str | None, money: bool = False) -> str | None:
    """The unit code that a unit text names; ``money``: the amount carries a currency sign already."""
    if text is None:
        return None
    bare = re.sub(r"\s+", " ", _tidy(text).replace(".", "").strip("() ")).removeprefix("in ").strip()
    if not bare:
        return "usd" if money else None
    if not money and bare in _CODE:
        return _CODE[bare]
    if bare.startswith("usd_"):
        return bare if bare in ("usd_thousand", "usd_million", "usd_billion", "usd_cent") else None
    left = re.sub(_MONEY_WORD, " ", bare)
    if left != bare:
        money = True
    left = re.sub(r"[() ]+", " ", left).strip().removeprefix("in ").strip()
    if money:
        if not left:
            return "usd"
        if left in ("cent", "cents", "¢"):
            return "usd_cent"
        scale = _SCALE.get(left)
        return f"usd_{scale}" if scale else None
    return None


def _spelled_number(words: str) -> float | None:
    total = part = 0
    seen = False
    for w in re.split(r"[ -]+", words.strip()):
        if w in WORDS:
            part, seen = part + WORDS[w], True
        elif w == "hundred":
            part = max(part, 1) * 100
        elif w in MULTIPLIERS:
            total, part = total + max(part, 1) * MULTIPLIERS[w], 0
    return float(total + part) if seen else None


@lru_cache(maxsize=65536)
def stated_amount(text: str | None) -> tuple[float, str | None] | None:
    """(number, unit code or None) if the whole text states one amount, else None.

    Ranges, placeholders and texts with anything else beside the amount are not read.
    """
    if text is None:
        return None
    t = _tidy(text)
    if not t:
        return None
    if m := _LENGTH.fullmatch(t):
        return float(m[1].replace(",", "")) + float(m[2]) / 12, "ft"
    m = _AMOUNT.fullmatch(t)
    if m and (m["num"] or m["vul"] or m["top"]):
        number = float(re.sub(r"[ ,]", "", m["num"]) or 0) if m["num"] else 0.0
        if m["vul"]:
            number += FRACTIONS[m["vul"]]
        elif m["top"]:
            if float(m["bottom"]) == 0:
                return None
            number += float(m["top"]) / float(m["bottom"])
        rest = m["rest"] or ""
        unit = unit_of(rest, bool(m["cur"]))
        return None if unit is None and rest.strip(" .") else (number, unit)
    if m := _WORDED.fullmatch(t):
        number = _spelled_number(m[1])
        unit = unit_of(m[2])
        if number is None or unit is None and m[2].strip(" ."):
            return None
        return number, unit
    return None


def trailing_unit(text: str | None) -> str | None:
    """The unit code after the leading number of a normalised text such as ``914.0 usd_thousand``."""
    if text is None:
        return None
    m = re.fullmatch(r"\s*[\d.,]+(?:e[+-]?\d+)?\s+(\S.*)", text, re.IGNORECASE)
    return unit_of(m[1]) if m else None
