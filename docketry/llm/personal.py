"""Finding personal data in free text and replacing it by typed placeholders.

Patterns propose spans with a base score; checksums and issue rules confirm or refute numbers that have them;
words nearby raise or lower the score; spans of at least ``ACCEPT`` stay, the earlier kind winning where two overlap.
Names are found by given names, titles and initials, and where none is known by two capitalised words of which
neither is an ordinary word of a public vocabulary, if what stands around them speaks of a person.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.tokens import FOLDER, VOCABULARY

ACCEPT = 0.5
#: Common given names (fixed values).
GIVEN = frozenset(
    """aaron abigail ada adam adriana ahmed aisha alan albert alejandro alex alexander alice alicia amanda amara amelia amina amir amy ana anders andre andrea andrew
    angela anita ann anna anne anneliese anthony antonio arthur ashley barbara beatrice benjamin bernard beth bianca brandon brenda brian bruce camila carl carla carlos carmen
    carol caroline catherine celia charles charlotte cheryl chloe chloë christina christopher clara claudia craig curtis cynthia daniel david deborah dennis diana diego dmitri
    donald donna doreen dorothy douglas edgar edward elena elise elizabeth ella ellen emily emma eric erika esther ethan eva evelyn farah fatima felix fernando fiona frances
    francisco frank gabriel gary george gerald gloria gordon gregory hannah harold harry hassan hector heather helen henry hugo ian imani ingrid irene isaac isabel ivan jack
    jacob james jamal jane janet jason javier jeffrey jennifer jeremy jerome jessica jesús joan joanna john jonathan jorge jose josé joseph joshua juan judith julia julian karen
    katherine keith kelly kenneth kevin kiran kwame larry laura lauren leif leila leonard linda lisa lorena louis lucas lucia lucy luis lydia maria maría mario marcus margaret
    martha martin mary matthew maya melissa michael michelle miguel miriam mohammed nadia nancy naomi natalie nathan nicholas nicole noah nolan noor nora olga olive oliver
    olivia omar oscar pablo pamela patricia patrice patrick paul paula pedro peter philip priya quinn rachel rafael ralph raymond rebecca renee renée ricardo richard robert roberto
    roger ronald rosa rose roy russell ruth ryan samantha samir samuel sandra sara sarah scott sean sergio sharon simon sofia sofía sonia stephanie stephen steven susan
    sylvia tamara teresa theo theodore theresa thomas timothy tomas tomás tyler ursula valerie vanessa vera veronica victor victoria vincent virginia walter wanda wayne wendy wesley
    william ximena yolanda yusuf zachary zelda zoe""".split()
)
#: Words after which a capitalised word is no surname: streets, places and firms (fixed values).
STREET = "street st avenue ave road rd lane ln drive dr court ct boulevard blvd way place pl terrace ter circle cir parkway pkwy highway hwy trail alley".split()
NOT_SURNAMES = frozenset(
    STREET
    + """park library school center centre hall bridge building yard shelter plaza field stadium church hospital county township village city river lake creek cemetery
    museum airport station inc llc ltd co corp corporation company group systems services supply associates engineering contracting paving environmental partners holdings
    foundation trust bank university college department division board commission committee council""".split()
)
#: Articles and the like that begin no name (fixed values).
_ARTICLES = frozenset("the a an el la los las un una unos unas lo al del de en y e o u su sus por para con sin esta este estas estos".split())
#: A vocabulary of many languages beside the English one.
MANY_LANGUAGES = "byte_bpe_multi_50k.tiktoken"
#: Words that may follow a name although they are no surnames: bodies and posts (fixed values).
_CIVIC = frozenset("council commission committee board division department school county city township village".split())
_SPACE = r"[  ]"
_CAP = r"[^\W\d_a-zà-öø-ÿ][\w'’]*"
_PART = rf"(?:(?:de{_SPACE}la|de{_SPACE}los|del|de|van{_SPACE}der|van|von|di|da|la|le|el|al|DE{_SPACE}LA|DEL|DE|VAN|VON){_SPACE})?"
_SURNAME = rf"{_PART}(?P<s>{_CAP}(?:-{_CAP})*)"
_SUFFIX = rf"(?:,?{_SPACE}(?:Sr|Jr|SR|JR)\b\.?|{_SPACE}(?:III|II|IV)\b)?"
_AFTER_GIVEN = re.compile(rf"(?:-{_CAP})?(?:{_SPACE}[^\W\d_a-z]\.)*{_SPACE}{_SURNAME}{_SUFFIX}")
_GIVEN_SECOND = re.compile(rf"(?:{_SPACE}[^\W\d_a-z]\.)*(?={_SPACE}*[;,.)\n]|{_SPACE}+[a-zñ]|$)")
_WORD = re.compile(_CAP)
_LAST_FIRST = re.compile(rf"(?<![\w'’-])({_CAP}(?:-{_CAP})*),\s?$")
_NEXT = re.compile(rf"{_SPACE}(?:&{_SPACE}\w+|({_CAP}))")
_TITLED = re.compile(rf"\b(?:M(?:rs?|s|x|iss)|Dr|Prof|Rev|Hon|(?:[Ee]l|[Ll]a|[Aa]l)\s(?:[Ss]r|[Ss]ra|[Ss]rta)|[Ss]eñor(?:a|ita)?|[Dd]oña|[Dd]on)\b\.?{_SPACE}+(?=[A-ZÀ-Þ])")
_AFTER_TITLE = re.compile(rf"(?:(?:{_CAP}|[A-Z]\.){_SPACE})?(?:[A-Z]\.{_SPACE})?{_SURNAME}{_SUFFIX}")
_SUR_ONLY = re.compile(rf"{_SURNAME}{_SUFFIX}")
_INITIAL = re.compile(rf"(?<![\w.'’&])(?<!\w-)(?<!\d )(?<!\d )(?<!Unit )(?<!Apt )(?<!Suite )(?<!Apt\. )(?:[^\W\d_a-z]\.{_SPACE}?){{1,2}}(?<=[  ]){_SURNAME}{_SUFFIX}")
#: What stands before and after the name of a person in letters, lists and minutes of any kind (fixed values).
_PERSON_BEFORE = re.compile(
    r"(?:\b(?:applicant|tenant|owner|resident|contact|attention|attn|dear|signed|submitted by|from|payee|witness(?:es)?|inspector|solicitante|firmado|presentado por|vecin[oa]|nombre|"
    r"council ?(?:member|man|woman)|commissioner|director|mayor|clerk|chair|heirs?|widow(?:er)? of|name is|according to|sincerely|regards|thanks|mr|mrs|ms|dr|señora?)\b[\s:,;.–—-]*)$",
    re.IGNORECASE,
)
_PERSON_AFTER = re.compile(
    r"\s*(?:,?\s*\(?(?:tel|phone|cell|e-?mail)\b|,?\s*\d{1,6}\s+[A-Z]|,?\s*(?:who|whose)\b|(?:said|says|asked|asks|wrote|writes|stated|called|claims|lives|resides|moved|seconded|spoke|owns|applied|complained|testified|vive|dijo|llamó)\b)",
    re.IGNORECASE,
)
#: What stands before the name of a place, a street or a firm (fixed values).
_PLACE_BEFORE = re.compile(r"\b(?:the|in|at|near|on|along|across|through|between|of|and|&|per|en|del?|la|el|calle|avenida|camino|paseo|plaza|via)\s+$", re.IGNORECASE)
_UNLISTED = re.compile(rf"(?<![\w'’.&-])({_CAP})((?:{_SPACE}[^\W\d_a-z]\.)*){_SPACE}{_SURNAME}{_SUFFIX}")
_BESIDE = re.compile(rf"\s*(?:,|;|\bor\b|\band\b|\bo\b|\by\b)\s*$", re.IGNORECASE)
_EMAIL = re.compile(
    r"(?<![\w.+-])[A-Za-z0-9](?:[\w.+-]*\w)?(?:\s?@\s?|\s?[\[({<]\s?(?:at|arroba|@)\s?[\])}>]\s?|\s(?:at|arroba)\s(?=[\w-]+\s?[\[(]?\s?(?:dot|punto)\b))"
    r"[A-Za-z0-9-]+(?:(?:\.|\s?[\[({]\s?(?:dot|punto)\s?[\])}]\s?|\s(?:dot|punto)\s)[A-Za-z0-9-]+)+",
    re.IGNORECASE,
)
_EMAIL_HINT = re.compile(r"@|[\[({<]\s?(?:at|arroba)\s?[\])}>]|\s(?:dot|punto)\s|[\[(]\s?(?:dot|punto)\b", re.IGNORECASE)
_DIGITS = re.compile(
    r"(?<![\w.,/$#+-])(?:(?P<phone>(?:\+?1[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\+1[ .-]?\d{3}[ .-]?\d{3}[ .-]?\d{4}|(?:1[ .-])?\d{3}(?P<p>[ .-])\d{3}(?P=p)\d{4})"
    r"|(?P<ssn>\d{3}(?P<q>[ .-])\d{2}(?P=q)\d{4})|(?P<local>\d{3}-\d{4})|(?P<ten>[2-9]\d{9})|(?P<nine>\d{9})|(?P<card>\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7})|(?P<foreign>\+\d{1,3}(?:[ .-]?\d{2,4}){3,4}))(?![\w/]|[.,-]\d)"
)
_LETTERED = re.compile(r"\b(?:(?P<iban>[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?)|(?P<doc>[A-Z]{1,3}-?\d{5,9}[A-Z]?))\b(?!/)")
_ID_CUE = re.compile(r"\b(?:ssn|social security|tax(?:payer)?|tin|itin|number is|id|identity|licen[cs]e|passport|pasaporte|dni|nie|cédula|número)\b", re.IGNORECASE)
_PHONE_CUE = re.compile(r"\b(?:call(?:ing)?|phone|tel|teléfono|cell|mobile|fax|reached|llamó|ext|móvil|contact)\b", re.IGNORECASE)
_NOT_PERSONAL = re.compile(r"\b(?:section|code|form|circular|account|acct|table|meter|docket|file|rfp|case|invoice|parcel|lot|item|no|ordinance|resolution|res|ord|fund|page|permit|ticket|chapter)\b\.?[^.;\n]{0,12}$", re.IGNORECASE)
_STREET_TYPE = "|".join(sorted(STREET, key=len, reverse=True))
_ADDRESS = re.compile(
    rf"(?<![\w.,/$#½-])\d{{1,6}}(?:½|¼|¾|{_SPACE}1/2|-?[A-Za-z](?![\w]))?{_SPACE}(?:(?:N|S|E|W|NE|NW|SE|SW|North|South|East|West)\b\.?{_SPACE})?"
    rf"(?P<w>(?:\d{{1,3}}(?:st|nd|rd|th)|[^\W\d_][\w'’-]*)(?:{_SPACE}[A-ZÀ-Þ][\w'’-]*)?){_SPACE}(?:{_STREET_TYPE})\b",
    re.IGNORECASE,
)
_CALLE = re.compile(rf"\b(?:calle|avenida|avda\.?|av\.|paseo|camino|carrera|plaza)(?:{_SPACE}(?:de|del|la|las|los|el))*{_SPACE}[^\W\d_][\w'’-]*(?:{_SPACE}[^\W\d_][\w'’-]*){{0,2}},?{_SPACE}(?:n(?:o|úm|\.º|º)\.?{_SPACE}?|#)?\d{{1,5}}\b", re.IGNORECASE)
#: Lower-case words that a number and a street word may enclose without being an address (fixed values).
_NOT_STREETS = frozenset("of the and on in at to by for with from new old per each feet foot miles acres days day year years month months square cubic linear tons pounds gallons metric short".split())


#: What a text must hold, in lower case, for a pattern to be worth trying (fixed values).
_TITLE_HINTS = ("mr", "ms", "miss", "dr", "prof", "rev", "hon", "señor", "sr", "doña", "don")
_CALLE_HINTS = ("calle", "avenida", "avda", "av.", "paseo", "camino", "carrera", "plaza")
_EMAIL_HINTS = ("@", "(at", "[at", "{at", "<at", "( at", "[ at", "{ at", "< at", "arroba", "dot", "punto")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for name in GIVEN:
        a.add_word(name, len(name))
    a.make_automaton()
    return a


_AUTOMATON = _automaton()


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> frozenset:
    """Words in lower case that a public vocabulary has as one token: ordinary words, and hardly any name."""
    with open(path, "rb") as f:
        tokens = (base64.b64decode(line.split()[0]).decode(errors="replace") for line in f)
        return frozenset(t[1:] for t in tokens if t.startswith(" ") and len(t) > 3 and t[1:].isalpha() and t[1:].islower())


def ordinary(word: str, any_language: bool = True) -> bool:
    low = word.lower()
    return low in _ARTICLES or low in _vocabulary(f"{FOLDER}/{VOCABULARY}") or any_language and low in _vocabulary(f"{FOLDER}/{MANY_LANGUAGES}")


def issued(number: str) -> bool:
    """Whether nine digits can be a social-security or taxpayer number: no area 000 or 666, no group 00, no serial 0000.

    Areas from 900 on, which only taxpayer numbers have, count as such.
    """
    return number[:3] not in ("000", "666") and number[3:5] != "00" and number[5:] != "0000"


def luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = int(ch) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(code: str) -> bool:
    code = code.replace(" ", "").upper()
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text: str, low: str) -> Iterator[tuple[float, int, int, str]]:
    """Looked for only around the signs that one may be there."""
    if not any(h in low for h in _EMAIL_HINTS):
        return
    upto = 0
    for hint in _EMAIL_HINT.finditer(text):
        at = max(upto, hint.start() - 120)
        while hint.start() >= upto and (m := _EMAIL.search(text, at, hint.end() + 160)):
            upto = at = m.end()
            yield 0.9, m.start(), upto, "email"


def _numbers(text: str) -> Iterator[tuple[float, int, int, str]]:
    for m in _DIGITS.finditer(text):
        kind, start, end = m.lastgroup, m.start(), m.end()
        before = text[max(0, start - 40) : start]
        kind = next(k for k in ("phone", "ssn", "local", "ten", "nine", "card", "foreign") if m[k])
        score = {"phone": 0.7, "ssn": 0.6, "local": 0.5, "ten": 0.5, "nine": 0.2, "card": 0.0, "foreign": 0.6}[kind]
        against = bool(_NOT_PERSONAL.search(before))
        if kind == "card":
            if luhn(re.sub(r"\D", "", m[0])):
                yield 0.9, start, end, "card"
            continue
        if kind in ("ssn", "nine"):
            if issued(re.sub(r"\D", "", m[0])):
                score += 0.5 * bool(_ID_CUE.search(before)) - 0.4 * against
                yield score, start, end, "id_number"
        else:
            score += 0.4 * bool(_PHONE_CUE.search(before[-25:])) - 0.4 * against
            yield score, start, end, "phone"
    for m in _LETTERED.finditer(text):
        if m["iban"]:
            if mod97(m[0]):
                yield 0.9, m.start(), m.end(), "iban"
            continue
        before = text[max(0, m.start() - 32) : m.start()]
        yield 0.3 + 0.4 * bool(_ID_CUE.search(before)), m.start(), m.end(), "id_number"


def _addresses(text: str, low: str) -> Iterator[tuple[float, int, int, str]]:
    for m in _ADDRESS.finditer(text):
        words = m["w"].casefold().split()
        if any(w in _NOT_STREETS for w in words):
            continue
        yield 0.8, m.start(), m.end(), "address"
    for m in _CALLE.finditer(text) if any(c in low for c in _CALLE_HINTS) else ():
        yield 0.8, m.start(), m.end(), "address"


def _surname(word: str) -> bool:
    return len(word) > 1 and word.casefold() not in NOT_SURNAMES


def _clear(text: str, end: int) -> bool:
    """No word of a firm or place follows."""
    m = _NEXT.match(text, end)
    return not m or bool(m[1]) and (m[1].casefold() not in NOT_SURNAMES or m[1].casefold() in _CIVIC)


def _given(text: str, low: str) -> Iterator[tuple[int, int]]:
    """Places of capitalised given names that are whole words; a hyphen may follow, a letter or apostrophe not."""
    if len(low) != len(text):  # lower case took another length: go word by word
        for m in _WORD.finditer(text):
            if m[0].casefold() in GIVEN:
                yield m.span()
        return
    for last, size in _AUTOMATON.iter(low):
        start, end = last - size + 1, last + 1
        if not text[start].isupper() or start and (text[start - 1].isalnum() or text[start - 1] == "_") or end < len(text) and (text[end].isalnum() or text[end] in "_'’"):
            continue
        yield start, end


def _names(text: str, low: str) -> Iterator[tuple[float, int, int, str]]:
    upto = 0
    for start, end in _given(text, low):
        if start < upto:
            continue
        follow = _AFTER_GIVEN.match(text, end)
        if follow and text[start:end].isupper() is follow["s"].isupper() and _surname(follow["s"]) and _clear(text, follow.end()):
            upto = follow.end()
            # a given name before an ordinary word is as often a place or a paper, so something must tell a person
            if plain := ordinary(follow["s"], any_language=False):
                before = text[max(0, start - 40) : start]
                plain = bool(_PLACE_BEFORE.search(before)) or not _PERSON_BEFORE.search(before) and not _PERSON_AFTER.match(text, upto)
            yield 0.8 - 0.4 * plain, start, upto, "name"
        elif text[max(0, start - 2) : start].strip() in (",",) and (tail := _GIVEN_SECOND.match(text, end)):
            before = _LAST_FIRST.search(text, max(upto, start - 80), start)
            if before and _surname(before[1]):
                upto = tail.end()
                yield 0.7, before.start(1), upto, "name"
    for m in _TITLED.finditer(text) if any(t in low for t in _TITLE_HINTS) else ():
        got = _AFTER_TITLE.match(text, m.end())
        if got and (not _surname(got["s"]) or got["s"].casefold() in ("asked",)):
            got = _SUR_ONLY.match(text, m.end())
        if got and _surname(got["s"]):
            yield 0.7, m.end(), got.end(), "name"
    for m in _INITIAL.finditer(text):
        if _surname(m["s"]) and m["s"].casefold() not in _STARTS and _clear(text, m.end()):
            yield 0.6, m.start(), m.end(), "name"
    last = -1
    for m in _UNLISTED.finditer(text):
        first, second = m[1], m["s"]
        if first.casefold() in GIVEN or not _surname(first) or not _surname(second) or first.isupper() or second.isupper() or ordinary(first) or ordinary(second.split("-")[0]):
            continue
        if not _clear(text, m.end()) or _NEXT.match(text, m.end()):
            continue
        before = text[max(0, m.start() - 40) : m.start()]
        score = 0.35 + 0.25 * bool(_PERSON_BEFORE.search(before)) + 0.2 * bool(_PERSON_AFTER.match(text, m.end())) - 0.3 * bool(_PLACE_BEFORE.search(before))
        beside = 0 <= last and m.start() - last < 8 and _BESIDE.fullmatch(text, last, m.start())
        sentence = not before.strip() or before.rstrip()[-1] in ".!?:;\n" or "\n" in before[-2:]
        score += 0.2 * bool(beside) + 0.15 * sentence
        if score >= ACCEPT:
            last = m.end()
        yield score, m.start(), m.end(), "name"


#: Words that begin sentences and are no surnames after a stray initial (fixed values).
_STARTS = frozenset("the a an in on at it its this that these those there under all any no not for from to by as if when where while after before with without and or but he she they we you your our his her their please see payment staff".split())


def spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each piece of personal data, in order, without overlaps."""
    if not text:
        return []
    found: list[tuple[int, int, str]] = []
    low = text.lower()
    layers = [
        list(_emails(text, low)),
        list(_numbers(text)),
        list(_addresses(text, low)),
        sorted(_names(text, low), key=lambda x: (-x[0], x[1])),
    ]
    for layer in layers:
        for score, start, end, kind in layer:
            if score >= ACCEPT and all(end <= s or start >= e for s, e, _ in found):
                found.append((start, end, kind))
    return sorted(found)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, kinds, starts, ends = [], [], [], []
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
            for start, end, kind in spans(text):
                keys.append(key)
                kinds.append(kind)
                starts.append(start)
                ends.append(end)
        yield pa.record_batch({"key": pa.array(keys, batch.column("key").type), "pii_kind": pa.array(kinds, pa.string()), "char_start": pa.array(starts, pa.int32()), "char_end": pa.array(ends, pa.int32())})


def find(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pii_kind, char_start, char_end): one row per piece; places count code points from 0.

    Kinds: email, phone, id_number, address, name, card (Luhn), iban (mod 97). A row at a time, without a
    shuffle; null and empty texts have no rows, repeated rows are read each time, long texts whole.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(_find, f"key {kind}, pii_kind string, char_start int, char_end int").withColumnRenamed("key", key)


def redacted(text: str | None) -> str | None:
    if text is None:
        return None
    out, at = [], 0
    for start, end, kind in spans(text):
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [redacted(t) for t in batch.column("text").to_pylist()]
        yield pa.record_batch({"key": batch.column("key"), "text": pa.array(texts, pa.string())})


def redact(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text): every text with each piece of personal data replaced by its kind in brackets; null stays null."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(_redact, f"key {kind}, text string").withColumnsRenamed({"key": key, "text": text})
