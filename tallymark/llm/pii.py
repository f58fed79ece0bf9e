"""Surrogates for personal data (operator 8).

Detected entities get keyed surrogates of their own kind: addresses, numbers and secrets go
through a keyed Feistel permutation of all strings of the same format (digits to digits,
letters to letters of their script and case, card numbers with a valid check digit, public
addresses to public ones), given names through a permutation of the names of the same gender and script, and
other names letter by letter, vowels to vowels. Equal entities get equal surrogates everywhere,
whatever their case or punctuation, since the permutation works on a normal form whose layout
is put back.

Collisions: a registry of the corpus' distinct entities is checked, kind by kind. Two entities
with one surrogate, or a surrogate that is itself an entity of the corpus, make one of them
take another key (``attempt``), until none is left. Formats of fewer than ``ROOMY`` strings are dealt
out exactly (``dealt``); no other name becomes a given name of the lists. Where a format has too few
free strings, like a list whose names all occur, or one of which the corpus fills a quarter (``CROWDED``),
surrogates are distinct and nobody's own, but may be other entities' strings. A format of a million strings
or more that the corpus fills to the last one raises an error. Only entities with an attempt above 0,
normally very few, travel back to the texts: by broadcast up to ``BROADCAST_ATTEMPTS``, beyond by a
join on a digest of the text, on which alone its entities depend.

Names: after a title; a known given name and what follows it; two or three capitalised words after words like
``Name:`` or ``Dear``, or right before an address or number; then also each part of these names where it stands by itself in
the same text. Numbers of accounts (IBAN) and
cards need valid check digits, and get them.

Defined results: a null text stays null. Repeated rows are replaced alike. Extra columns are kept
and may have any name. An empty table gives an empty one.
Whole texts are searched; a text is handed to Python's patterns only if a vectorised
screen, which no entity escapes, finds a digit, one of ``@=:``, the head of a key, or a title,
given name or word that introduces names before a capital in it.
"""

from __future__ import annotations

import hashlib
import ipaddress
import math
import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.llm.store import settle, temporary

KEY = "tallymark"
BROADCAST_ATTEMPTS = 20_000
MAX_ROUNDS = 60
#: Formats with fewer strings than this are dealt out whole, each in one group; they may be too full to avoid the corpus' own entities.
ROOMY = 1_000_000
ROUNDS = 8
#: The share of a format's strings from which surrogates may be entities of the corpus.
CROWDED = 0.25

# Given names by gender and script, titles by gender.
GIVEN = {
    ("f", "latin"): "Alice Anna Barbara Carla Carmen Catherine Clara Claire Diana Elena Elisabeth Emma Eva Greta Helen Ines Jane Julia Karen Laura Linda Lucia Maria Marie Martha Mary Nina Olivia Paula Rosa Ruth Sarah Sofia Susan Sylvie Teresa".split(),
    ("m", "latin"): "Adam Albert Andreas Antonio Carlos Charles Daniel David Diego Edward Felix Frank George Hans Henri Hugo Jack James Jean John Jorge Juan Karl Louis Lucas Luis Marc Martin Michael Oscar Paul Pedro Peter Robert Thomas William".split(),
    ("f", "cyrillic"): "Алла Анна Вера Галина Дарья Елена Ирина Лидия Мария Нина Ольга Софья Татьяна Юлия".split(),
    ("m", "cyrillic"): "Алексей Андрей Борис Виктор Глеб Денис Иван Игорь Михаил Николай Олег Павел Пётр Юрий".split(),
}
TITLES = {
    "f": "Mrs Ms Miss Madam Frau Mme Madame Mlle Señora Sra Srta".split(),
    "m": "Mr Sir Herr Monsieur Señor Sr".split(),
    "": "Dr Prof".split(),
}
#: Words after which a name stands if a colon or comma follows them, or a space; and words that are no second surname.
BEFORE_NAMES, GREETINGS = "name contact attn attention signed sincerely regards author patient employee recipient sender".split(), ["dear"]
NO_SURNAMES = "The A An And But Or In On At To Of For From By With He She It They We You I Is Was Has Had His Her Its Their This That These Those When Then There Here".split()
ALPHABETS = {
    "digit": "0123456789",
    "latin_lower": "abcdefghijklmnopqrstuvwxyz", "latin_upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "cyrillic_lower": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "cyrillic_upper": "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
    "greek_lower": "αβγδεζηθικλμνξοπρστυφχψω", "greek_upper": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
}
HEX = "0123456789abcdef"
VOWELS = "aeiouyаеиоуыэюяαειοηυωаеиоу"

_TITLE = {t: g for g, titles in TITLES.items() for t in titles}
_GENDER = {n: (g, s) for (g, s), names in GIVEN.items() for n in names}
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_UPPER, _LOWER = "[A-ZÀ-ÖØ-ÞΑ-ΩА-ЯЁ]", "[a-zß-öø-ÿά-ώа-яё]"
_NAME = rf"{_UPPER}(?:['’]{_UPPER})?{_LOWER}+(?:[-'’]?{_UPPER}{_LOWER}+)*"
_CUES = "|".join(BEFORE_NAMES)
#: Tried in this order at each place; a group named v is what is replaced, else all of the match.
PATTERNS = {
    "email": r"@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}[A-Za-z0-9])?)+",  # and LOCAL before it
    "secret": r"(?i:\b(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key)\s*[=:]\s*[\"']?)(?P<v>[^\s\"'<>,;]{4,}?)(?=[\s\"'<>,;]|\.?$|\.\s)",
    "key": r"\b(?:AKIA|ASIA|AGPA|AIDA|AROA)(?P<k>[0-9A-Z]{16})\b|\b(?:ghp|gho|ghs|xoxb|xoxp|sk)[_-][A-Za-z0-9_-]{16,}",
    "bearer": r"(?i:\bbearer) +(?=[^\s]*\d)(?P<v>[A-Za-z0-9._~+/-]{12,}=*)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv6": r"(?<![\w:.])(?=[A-Fa-f:]*\d)[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "card": r"(?<![\d+])\d(?:[ -]?\d){12,}",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])|(?<![\w.,/:+-])0\d{1,4}[ /-]\d{5,8}(?![\w-])|(?<![\w.,/:+-])0\d(?:[ .-]\d{2}){4}(?![\w-])",
    "name": rf"\b(?P<t>{'|'.join(sorted(_TITLE, key=len, reverse=True))})\.? (?P<n>{_NAME}(?: {_NAME}){{0,2}})"
    rf"|\b(?P<g>(?:(?:{'|'.join(sorted(_GENDER))}) )+)(?P<s>{_NAME}(?: (?!(?:{'|'.join(NO_SURNAMES)})\b){_NAME}(?![\w.]))?)"
    rf"|\b(?:(?i:{_CUES}) ?[:,] ?|(?i:{'|'.join(GREETINGS)}) )(?P<c>{_NAME}(?: {_NAME}){{1,2}})|\b(?P<b>{_NAME}(?: {_NAME}){{1,2}})(?=,? ?[<(\[]?\0)",
}
#: What may stand before the sign of an address, of which the last LOCAL_SIGNS are looked at, so that long runs of letters are read once.
LOCAL, LOCAL_SIGNS = re.compile(r"[\w.%+-]+\Z"), 256
#: How numbers of cards begin, by their length; asked of those that stand among other numbers.
ISSUERS = re.compile(r"4(?:\d{12}|\d{15}|\d{18})|(?:5[1-5]|2[2-7]|6[0245]|35|62|81)\d{14}|(?:6[0-9]|5[0678]|62)\d{10,17}|3[47]\d{13}|3[0689]\d{12}")
#: For RE2, whose \b and \d know ASCII only: matches wherever one of PATTERNS does.
_SCREEN = rf"[\p{{Nd}}@=:]|(?:AKIA|ASIA|AGPA|AIDA|AROA)[0-9A-Z]|(?:ghp|gho|ghs|xoxb|xoxp|sk)[_-][A-Za-z0-9_-]|(?:{'|'.join([*_TITLE, *_GENDER])})\.? {_UPPER}|(?i:{_CUES}) ?, ?{_UPPER}|(?i:{'|'.join(GREETINGS)}) {_UPPER}"


_WORD = re.compile(rf"(?<!\w){_NAME}(?!\w)")


@lru_cache(maxsize=1)
def _patterns() -> dict[str, re.Pattern]:
    return {k: re.compile(v) for k, v in PATTERNS.items()}


def luhn(digits: str) -> int:
    """The check digit that ``digits`` lack."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def iban_check(number: str) -> str:
    """The two check digits of an account number, given as country and what follows the check digits."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in f'{number[2:]}{number[:2]}00')) % 97:02}"


def permute(x: int, size: int, key: str) -> int:
    """A keyed permutation of range(size): a Feistel network over a rectangle, walked into range."""
    if size <= 1:
        return x
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)
    secret = hashlib.blake2b(key.encode(), digest_size=32).digest()
    width = (size.bit_length() + 7) // 8 + 8
    draw = lambda i, v: int.from_bytes(hashlib.shake_128(secret + bytes([i]) + v.to_bytes(width, "big")).digest(width), "big")
    while True:
        left, right = x % a, x // a
        for i in range(ROUNDS):
            if i % 2 == 0:
                left = (left + draw(i, right)) % a
            else:
                right = (right + draw(i, left)) % b
        x = left + a * right
        if x < size:
            return x


def _alphabet(sign: str, names: bool) -> str | None:
    for letters in ALPHABETS.values():
        if sign in letters:
            if names and not sign.isdigit():
                vowel = sign.lower() in VOWELS
                return "".join(c for c in letters if (c.lower() in VOWELS) == vowel)
            return letters
    return None


def _strings(text: str, alphabets: list[str | None]) -> tuple[str, int, int, Callable[[int], str]]:
    """The format of a text, its place among the strings of that format, how many those are, and the string of a place."""
    size, x = 1, 0
    for sign, letters in zip(text, alphabets, strict=True):
        if letters:
            x, size = x * len(letters) + letters.index(sign), size * len(letters)
    fixed = "".join("." if a else c for c, a in zip(text, alphabets, strict=True))

    def spell(y: int) -> str:
        out = []
        for sign, letters in zip(reversed(text), reversed(alphabets), strict=True):
            if letters:
                y, k = divmod(y, len(letters))
                sign = letters[k]
            out.append(sign)
        return "".join(reversed(out))

    return f"{fixed}|{[(a[0], len(a)) if a else 0 for a in alphabets]}", x, size, spell


def permute_text(text: str, key: str, alphabets: list[str | None]) -> tuple[str, int]:
    """Permute the strings of this format; signs without an alphabet stay. Also how many there are."""
    layout, x, size, spell = _strings(text, alphabets)
    return spell(permute(x, size, f"{key}|{layout}")), size


def _private(x: int) -> tuple[int, int] | None:
    """The reserved range that an address is in."""
    for low, bits in ((0x0A000000, 24), (0xAC100000, 20), (0xC0A80000, 16), (0x7F000000, 24), (0x00000000, 24), (0xE0000000, 29), (0xA9FE0000, 16)):
        if low <= x < low + (1 << bits):
            return low, 1 << bits
    return None


def _dotted(x: int) -> str:
    return ".".join(map(str, x.to_bytes(4, "big")))


def spelled(kind: str, value: str) -> tuple[str, int, int, Callable[[int], str]]:
    """What ``_strings`` says, for an entity in normal form."""

    def inside(head: str, body: str, alphabets: list[str | None], tail: Callable[[str], str] = lambda new: "", note: str = ""):
        layout, x, size, spell = _strings(body, alphabets)

        def whole(y: int) -> str:
            new = head + spell(y)
            return new + tail(new) if kind != "iban" else head + iban_check(new) + new[2:]

        return f"{head}|{note}|{layout}", x, size, whole

    if kind == "ip":
        x = int.from_bytes(bytes(map(int, value.split("."))), "big")
        low, size = _private(x) or (0, 1 << 32)
        return f"{low}/{size}", x - low, size, lambda y: _dotted(low + y)
    if kind == "card":
        valid = luhn(value[:-1]) == int(value[-1])
        body = value[1:-1] if valid else value[1:]
        return inside(value[0], body, [ALPHABETS["digit"]] * len(body), lambda new: str(luhn(new)) if valid else "", str(valid))
    if kind == "iban":
        return inside(value[:2], value[4:], [ALPHABETS["digit"] if c.isdigit() else ALPHABETS["latin_upper"] for c in value[4:]], lambda new: "", "check")
    if kind == "ipv6":
        return inside(value[:4], value[4:], [HEX] * 28)
    if kind == "phone":
        country = len(value) - 10 if value.startswith("+") and len(value) > 11 else 1 if value[:1] in ("+", "0") else 0
        fixed, body = value[: max(country, 0)], value[max(country, 0) :]
        return inside(fixed, body, [ALPHABETS["digit"] if c.isdigit() else None for c in body])
    if kind == "email":
        local, _, host = value.rpartition("@")
        names, _, top = host.rpartition(".")
        whole = f"{local}@{names}"
        return inside("", whole, [_alphabet(c, False) for c in whole], lambda new: f".{top}", top)
    if kind.startswith("given"):
        _, gender, script = kind.split("-")
        names = GIVEN[(gender, script)]
        return "list", names.index(value), len(names), names.__getitem__
    if kind == "name":
        return inside("", value, [_alphabet(c, True) for c in value])
    if kind == "secret" and len(value) >= 8 and all(c in HEX for c in value):
        return inside("", value, [HEX] * len(value))
    if kind == "key" and value[:4] in ("AKIA", "ASIA", "AGPA", "AIDA", "AROA"):
        return inside(value[:4], value[4:], [ALPHABETS["latin_upper"] + ALPHABETS["digit"]] * (len(value) - 4))
    return inside("", value, [_alphabet(c, False) for c in value])


def surrogate(kind: str, value: str, attempt: int = 0, key: str = KEY) -> tuple[str, int]:
    """The surrogate of an entity in normal form, and how many strings its format has.

    An attempt is another permutation, and in a format that is not roomy so many places further on.
    """
    layout, x, size, spell = spelled(kind, value)
    if size < ROOMY:
        return spell((permute(x, size, f"{key}|{kind}|0|{layout}") + attempt) % size), size
    key = f"{key}|{kind}|{attempt}|{layout}"
    y = permute(x, size, key)
    while kind == "ip" and size == 1 << 32 and _private(y):
        y = permute(y, size, key)
    return spell(y), size


@lru_cache(maxsize=1)
def _listed() -> dict[str, set[int]]:
    """Places of the given names among the strings of their formats, as other names."""
    out: dict[str, set[int]] = {}
    for name in _GENDER:
        layout, x, _, _ = spelled("name", name)
        out.setdefault(layout, set()).add(x)
    return out


def dealt(places: list[int], starts: list[int], size: int, taken: set[int], barred: set[int]) -> list[int]:
    """A place for each entity of one format: from its start on the first that is free.

    Free is what no entity and no other has, is not ``taken`` and not ``barred``. Where that is too
    little, the entities that get none pass their own strings on in a circle.
    """
    n, after = len(places), {t: (t + 1) % size for t in {*places, *taken, *barred}}
    rest = max(0, n - (size - len(after)))
    rest = 2 if rest == 1 and n > 1 else rest
    order, out = sorted(range(n), key=starts.__getitem__), [0] * n
    for i in order[: n - rest]:
        t, trail = starts[i], []
        while t in after:
            trail.append(t)
            t = after[t]
        for u in trail:
            after[u] = t
        out[i], after[t] = t, (t + 1) % size
    circle = order[n - rest :]
    for i, j in zip(circle, [*circle[1:], *circle[:1]], strict=True):
        out[i] = places[j]
    if rest == 1:  # the only entity, and nothing is free
        x = places[0]
        out[0] = next((t for d in (barred, ()) for k in range(1, size) if (t := (x + k) % size) not in d), x)
    return out


def normal(kind: str, shown: str) -> str:
    """What equal entities share, however they are written."""
    if kind in ("card", "ssn"):
        return "".join(str(int(c)) for c in shown if c.isdigit())
    if kind == "phone":
        return "".join(c if c == "+" else str(int(c)) for c in shown if c.isdigit() or c == "+")
    if kind == "iban":
        return shown.replace(" ", "")
    if kind == "ipv6":
        return ipaddress.IPv6Address(shown).exploded.replace(":", "")
    return shown.lower() if kind == "email" else shown.replace("’", "'") if kind == "name" else shown


def laid_out(kind: str, shown: str, new: str) -> str:
    """A surrogate in the layout of the entity that it stands for."""
    if kind in ("card", "ssn", "phone", "iban"):
        signs = iter(new)
        return "".join(next(signs) if c.isdigit() or c == "+" or kind == "iban" and c != " " else c for c in shown)
    if kind == "ipv6":
        return ipaddress.IPv6Address(":".join(new[i : i + 4] for i in range(0, 32, 4))).compressed
    if kind == "email":
        return "".join(n.upper() if s.isupper() else n for n, s in zip(new, shown, strict=True))
    return new


def cards(run: str) -> list[tuple[int, int]]:
    """Spans of card numbers in a run of digits that single spaces and hyphens part.

    They start and end at separators, have 13 to 19 digits and a valid check digit. Those that are part of a longer run,
    or not grouped as cards are, must begin as the numbers of card issuers do; those that are part of a longer run are also grouped as
    cards are, and what stands beside them is not another group like theirs, as in a table of numbers, unless that belongs to another card. Of those that overlap, one
    grouped as cards are comes first, then that with most digits, then the first.
    """
    parts = [m.span() for m in re.finditer(r"\d+", run)]
    found, among = [], {}
    for i, (start, _) in enumerate(parts):
        digits, groups = "", []
        if i and parts[i][1] - start != 4 and not 13 <= parts[i][1] - start <= 19:  # starts no part of a run that is grouped as cards are
            continue
        for j, (low, end) in enumerate(parts[i : i + 20], i):
            if len(digits) + end - low > 19:
                break
            digits += normal("card", run[low:end])
            groups.append(end - low)
            if len(digits) >= 13 and luhn(digits[:-1]) == int(digits[-1]):
                usual = len(groups) == 1 or groups in ([4, 6, 5], [4, 6, 4]) or set(groups[:-1]) == {4} and groups[-1] <= 4 and len(digits) >= 16
                whole = i == 0 and j == len(parts) - 1
                if whole and (usual or ISSUERS.fullmatch(digits)):
                    found.append((not usual, -len(digits), start, end))
                elif usual and ISSUERS.fullmatch(digits):
                    among[i, j] = (False, -len(digits), start, end)
    for (i, j), span in among.items():
        inside = set(run[span[2] : span[3]]) & set(" -") or set(" -")
        like = {b - a for a, b in parts[i : j + 1]}
        # a group of the same size and separator beside it belongs to another card, or all are numbers of a table
        before = i > 0 and run[span[2] - 1] in inside and parts[i - 1][1] - parts[i - 1][0] in like and not any(e == i - 1 for _, e in among)
        after = j + 1 < len(parts) and run[span[3]] in inside and parts[j + 1][1] - parts[j + 1][0] in like and not any(s == j + 1 for s, _ in among)
        if not before and not after:
            found.append(span)
    taken: list[tuple[int, int]] = []
    free = bytearray(b"\1") * len(run)
    for _, _, start, end in sorted(found):
        if 0 not in free[start:end]:
            taken.append((start, end))
            free[start:end] = bytes(end - start)
    return sorted(taken)


def account(run: str) -> int:
    """Where an account number with valid check digits ends that starts the run; 0 if there is none."""
    for end in range(len(run), 14, -1):
        value = run[:end].replace(" ", "")
        if run[end - 1] != " " and (end == len(run) or run[end] == " ") and 15 <= len(value) <= 34 and iban_check(value[:2] + value[4:]) == value[2:4]:
            return end
    return 0


def address(shown: str) -> bool:
    try:
        return len(ipaddress.IPv6Address(shown).compressed) >= 6
    except ValueError:
        return False


def detect(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities, in order, without overlap; earlier kinds win."""
    found: list[tuple[int, int, str]] = []
    whole = text

    def add(start: int, end: int, kind: str) -> None:
        found.append((start, end, kind))

    at = last_address = 0
    for kind, pattern in _patterns().items():
        if len(found) > at:  # what is found is blanked for the kinds after it
            last, parts = 0, []
            for start, end, _ in sorted(found[at:]):
                parts += [text[last:start], "\0" * (end - start)]
                last = end
            text, at = "".join([*parts, text[last:]]), len(found)
        for m in pattern.finditer(text):
            if kind == "email":
                if local := LOCAL.search(text[max(last_address, m.start() - LOCAL_SIGNS) : m.start()]):
                    add(m.start() - len(local[0]), m.end(), kind)
                    last_address = m.end()
            elif kind == "card":
                for start, end in cards(m[0]):
                    add(m.start() + start, m.start() + end, kind)
            elif kind == "iban":
                if end := account(m[0]):
                    add(m.start(), m.start() + end, kind)
            elif kind == "ipv6":
                if address(m[0]):
                    add(*m.span(), kind)
            elif kind == "name":
                group = next(g for g in "ngcb" if m[g])
                parts = m[group] if group != "g" else f"{m['g']}{m['s']}"
                place = m.start(group)
                words, gender = parts.split(" "), _TITLE.get(m["t"] or "", "")
                for i, word in enumerate(words):
                    own = _GENDER.get(word)
                    given = own and i < len(words) - 1 and gender in ("", own[0])
                    add(place, place + len(word), f"given-{own[0]}-{own[1]}" if given else "name")
                    place += len(word) + 1
            elif kind in ("secret", "bearer"):
                add(*m.span("v"), kind)
            else:
                add(*m.span(), kind)
    # a name or given name that stands by itself elsewhere in the text is that of the same person
    parts = {whole[s:e]: kind for s, e, kind in found if kind == "name" or kind.startswith("given")}
    if parts:
        last, shown = 0, []
        for start, end, _ in sorted(found[at:]):
            shown += [text[last:start], "\0" * (end - start)]
            last = end
        for m in _WORD.finditer("".join([*shown, text[last:]])):
            if m[0] in parts:
                add(*m.span(), parts[m[0]])
    return sorted(found)


def _screened(column: pa.Array) -> list[bool]:
    return pc.fill_null(pc.match_substring_regex(column, _SCREEN), False).to_pylist()


def entities(docs: DataFrame, text_col: str = "text", digests: bool = False) -> DataFrame:
    """Distinct (kind, value) of the corpus, or with ``digests`` (digest, kind, value), by the MD5 of the text."""
    lead = ["digest"] if digests else []
    rows = docs.select(*([F.md5(text_col).alias("digest")] if digests else []), F.col(text_col).alias("__text"))

    def work(batches):
        for batch in batches:
            texts = batch.column(len(lead))
            ids = batch.column(0).to_pylist() if lead else [None] * batch.num_rows
            out = set()
            for i, hit in enumerate(_screened(texts)):
                if hit:
                    text = texts[i].as_py()
                    out.update((ids[i], kind, normal(kind, text[s:e])) for s, e, kind in detect(text))
            got = sorted(out, key=str)
            yield pa.RecordBatch.from_arrays([*[pa.array([x[0] for x in got], batch.schema.field(0).type) for _ in lead], pa.array([x[1] for x in got], pa.string()), pa.array([x[2] for x in got], pa.string())], [*lead, "kind", "value"])

    schema = T.StructType([*[rows.schema[c] for c in lead], T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())])
    return rows.mapInArrow(work, schema).distinct()


def registry(found: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, value, attempt, surrogate) without collisions, from distinct (kind, value)."""

    def fill(rows: DataFrame) -> DataFrame:
        def work(batches):
            for batch in batches:
                got = []
                for kind, value, attempt, crowded in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    new, size = surrogate(kind, value, attempt, key)
                    got.append((kind, value, attempt, crowded, new, float(size), f"{kind}|{spelled(kind, value)[0]}"))
                    if kind == "name" and value in _GENDER and not attempt:  # a given name's surrogate should not be this
                        got.append((kind, value, -1, False, value, 0.0, f"given-{'-'.join(_GENDER[value])}|list"))
                types = (pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.float64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], t) for i, t in enumerate(types)], ["kind", "value", "attempt", "crowded", "surrogate", "size", "layout"])

        return rows.select("kind", "value", "attempt", "crowded").mapInArrow(work, "kind string, value string, attempt int, crowded boolean, surrogate string, size double, layout string")

    def deal(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("value", "kind", "attempt")), strict=True))
        own = [(v, k) for v, k, a in rows if a >= 0]
        out = []
        if own:
            forms = [spelled(k, v) for v, k in own]
            layout, _, size, spell = forms[0]
            kind = own[0][1]
            names = GIVEN[tuple(kind.split("-")[1:])] if kind.startswith("given") else []
            taken = {names.index(v) for v, _, a in rows if a < 0}
            places = [f[1] for f in forms]
            starts = [permute(x, size, f"{key}|{kind}|0|{layout}") for x in places]
            goals = dealt(places, starts, size, taken, _listed().get(layout, set()) if kind == "name" else set())
            out = [(k, v, (t - s) % size, spell(t)) for (v, k), s, t in zip(own, starts, goals, strict=True)]
        types = (pa.string(), pa.string(), pa.int32(), pa.string())
        return pa.table([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], ["kind", "value", "attempt", "surrogate"])

    every = settle(fill(found.select("kind", "value", F.lit(0).alias("attempt"), F.lit(False).alias("crowded"))), "pii-registry")
    small = every.where(F.col("size") < ROOMY).groupBy("layout").applyInArrow(deal, "kind string, value string, attempt int, surrogate string")
    table = every.where(F.col("size") >= ROOMY).select("kind", "value", "attempt", "crowded", "surrogate", "layout")
    # a layout comes here only with ROOMY x CROWDED entities or more
    full = every.where(F.col("size") >= ROOMY).groupBy("layout").agg(F.count("*").alias("n"), F.max("size").alias("size")).where(F.col("n") >= CROWDED * F.col("size"))
    full = full.select("layout", F.lit(True).alias("full"))
    if full.limit(1).count():
        table = table.join(settle(full, "pii-crowded"), "layout", "left").withColumn("crowded", F.coalesce("full", F.lit(False))).drop("full")
    table = table.drop("layout")
    given = (F.col("kind") == "name") & F.col("surrogate").isin(sorted(_GENDER))
    for _ in range(MAX_ROUNDS):
        real = table.select("kind", F.col("value").alias("surrogate")).distinct().withColumn("real", F.lit(True))
        # the entity with the fewest attempts keeps a surrogate that several have
        first = table.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "value")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        judged = table.join(real, ["kind", "surrogate"], "left").join(first, ["kind", "surrogate"], "left")
        taken = F.coalesce(F.col("real"), F.lit(False)) & (~F.col("crowded") | (F.col("surrogate") == F.col("value")))
        again = taken | F.coalesce(F.col("first.value") != F.col("value"), F.lit(False)) | given
        judged = judged.select("kind", "value", "attempt", "crowded", "surrogate", again.alias("again"))
        if not judged.where("again").limit(1).count():
            return table.drop("crowded").unionByName(small)
        judged = settle(judged, "pii-judged")
        moved = fill(judged.where("again").select("kind", "value", (F.col("attempt") + 1).alias("attempt"), "crowded")).drop("size", "layout").where("attempt >= 0")
        table = settle(judged.where("not again").drop("again").unionByName(moved), "pii-registry")
    raise RuntimeError(f"surrogates still collide after {MAX_ROUNDS} rounds")


def replace(docs: DataFrame, text_col: str = "text", key: str = KEY, report: bool = False, broadcast: int = BROADCAST_ATTEMPTS) -> DataFrame:
    """``docs`` with surrogates in their texts; ``report`` adds n_entities and spans (start, end, kind of the new text)."""
    with temporary() as keep:
        moved = registry(entities(docs, text_col), key).where("attempt > 0").select("kind", "value", "attempt")
        few = moved.limit(broadcast + 1).collect()
        if by_row := len(few) > broadcast:
            moved = keep(settle(moved, "pii-moved"))
    names = docs.columns
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])
    at, attempts = names.index(text_col), {}
    if by_row:
        own = entities(docs, text_col, digests=True).join(moved, ["kind", "value"])
        own = own.groupBy("digest").agg(F.collect_list(F.struct("kind", "value", "attempt")).alias("moved"))  # those of one text
        rows = rows.join(own, F.md5(f"c{at}") == F.col("digest"), "left").drop("digest")
    else:
        attempts = {(r["kind"], r["value"]): r["attempt"] for r in few}
    shared = docs.sparkSession.sparkContext.broadcast(attempts)
    extra = [T.StructField("n_entities", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())])))]
    schema = T.StructType([*[T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)], *(extra if report else [])])
    n_columns = len(names)

    def work(batches):
        known: dict[tuple[str, str], str] = {}
        for batch in batches:
            column = batch.column(at)
            texts, spans = column.to_pylist(), [[] for _ in range(batch.num_rows)]
            for i, hit in enumerate(_screened(column)):
                if not hit:
                    continue
                text, out, last, size = texts[i], [], 0, 0
                own = {(x["kind"], x["value"]): x["attempt"] for x in batch.column(n_columns)[i].as_py() or []} if by_row else shared.value
                for s, e, kind in detect(text):
                    shown = text[s:e]
                    value = normal(kind, shown)
                    tried = own.get((kind, value), 0)
                    if (new := known.get((kind, value, tried))) is None:
                        if len(known) > 100_000:
                            known.clear()
                        new = known[kind, value, tried] = surrogate(kind, value, tried, key)[0]
                    new = laid_out(kind, shown, new)
                    out += [text[last:s], new]
                    size += s - last
                    spans[i].append({"start": size, "end": size + len(new), "kind": kind})
                    size, last = size + len(new), e
                texts[i] = "".join([*out, text[last:]])
            columns = [batch.column(k) for k in range(n_columns)]
            columns[at] = pa.array(texts, pa.string())
            if report:
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
                columns += [pa.array([len(x) for x in spans], pa.int64()), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])

    out = rows.mapInArrow(work, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], *(["n_entities", "spans"] if report else []))
