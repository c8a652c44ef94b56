"""Surrogates for personal data: keyed replacements of the same type, script and format, distinct where the originals are.

Detected: e-mail addresses, phone numbers, IPv4 addresses, card numbers (issuer prefix and Luhn), IBANs (mod 97), US social
security numbers, secrets (values after password, token and the like; cloud access keys) and names after a form of address,
which are then found in the rest of their text too. Digits may be of any script.

Every entity has a canonical form, and the surrogate is a function of key, type, canonical form and attempt, so mentions of
one entity stay one entity (coreference). Digits and letters of an identifier are permuted by a keyed Feistel network over
exactly the strings of the same format (a digit stays a digit of its script, a letter stays in its case and its block of the
script, checksums are recomputed): this keeps distinct identifiers of a format distinct. A name's surrogate is built in its
script; a given name's ending tells its gender, and a family name keeps the form it is inflected in (-ов, -ова). A given name
is one entity under all forms of address of a gender; under one that tells none it takes the gender that its text, or else the
corpus, gives it (masculine where the corpus gives both).

Collision checks run over all distinct entities: a surrogate must differ from every detected original of its type and from
every other entity's surrogate; of entities that share one, the least keeps it. The others go to their next attempt until
none collides. After FORMAT_ATTEMPTS attempts a format counts as exhausted, and surrogates get longer by keyed characters of
their type with each attempt: no input can use up all surrogates. Only entities beyond attempt 0, or of another gender than
their form of address tells, need a table when texts are rewritten: it is broadcast if it is counted to be small, and
otherwise joined, by text, to the documents that need it.

The key is the caller's and must be kept secret: whoever has it can undo the permutations.

Defined results: a null text stays null; a text without entities is unchanged. Equal texts get equal results. Rows stay rows,
whatever their ids. Overlapping matches go to the one that begins first, then the longest. A value after password and the like
that has no letter or digit (``********``) is a mask and stays. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cut, load, map_arrow, map_rows

#: Entities that may be broadcast.
BROADCAST_ENTITIES = 200_000
#: Attempts within a format, before surrogates get longer.
FORMAT_ATTEMPTS = 6
#: Characters that are permuted as one number.
PIECE = 256

# ---------------------------------------------------------------- detection

#: Forms of address by the gender that they tell.
ADDRESS = {"m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "господин", "г-н", "κύριος"), "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Doña", "госпожа", "г-жа", "κυρία"), "n": ("Dr", "Prof")}
_GENDER = {a: g for g, names in ADDRESS.items() for a in names}
_NAME = r"[^\W\d_a-zà-öø-ÿа-яα-ω][^\W\d_]+(?:[-'’][^\W\d_]+)?"

_EMAIL = re.compile(r"(?<![\w.+-])[\w.+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}(?![\w-])")
_PHONE = re.compile(r"(?<![\w+(.-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{4}(?![\w-])|(?<![\w+])\+\d{8,15}(?!\w)")
_IPV4 = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\w|\.[0-9])")
_CARD = re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
_SECRET = re.compile(r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key))[\"']?\s*[=:]\s*[\"']?([^\s\"',;<>]{6,})")
_ACCESS = re.compile(r"(?<!\w)A[KS]IA[0-9A-Z]{16}(?!\w)")
_PERSON = re.compile(rf"(?<!\w)({'|'.join(map(re.escape, sorted(_GENDER, key=len, reverse=True)))})\.?[ \xa0]({_NAME})(?:[ \xa0]({_NAME}))?")
_WORD = re.compile(rf"(?<!\w){_NAME}")
#: Issuer prefixes of cards and the numbers of digits that they have (ISO/IEC 7812 assignments), fixed values: first, last, least, most.
ISSUERS = (("4", "4", 13, 19), ("51", "55", 16, 16), ("2221", "2720", 16, 16), ("34", "34", 15, 15), ("37", "37", 15, 15), ("300", "305", 14, 19), ("36", "36", 14, 19), ("38", "39", 14, 19), ("3528", "3589", 16, 19), ("6011", "6011", 16, 19), ("644", "649", 16, 19), ("65", "65", 16, 19), ("62", "62", 16, 19), ("50", "50", 13, 19), ("56", "58", 13, 19), ("63", "63", 13, 19), ("67", "67", 13, 19))
#: What a text must hold for a pattern to be tried.
_DIGIT, _HINT = re.compile(r"\d"), re.compile(r"(?i)pass|pwd|secret|token|key")


def digits_of(text: str) -> str:
    """The text's decimal digits, of whatever script, as ASCII."""
    return "".join(str(unicodedata.decimal(c)) for c in text if c.isdecimal())


def luhn(digits: str) -> int:
    """The check digit of the digits before it."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (2 if k % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return -total % 10


def iban_check(country: str, rest: str) -> str:
    number = int("".join(str(int(c, 36)) for c in rest + country + "00"))
    return f"{98 - number % 97:02d}"


def issuer(digits: str) -> str:
    """The issuer prefix of a card number, empty if there is none of that length."""
    for first, last, least, most in ISSUERS:
        if least <= len(digits) <= most and first <= digits[: len(first)] <= last:
            return digits[: len(first)]
    return ""


def _is_card(text: str) -> bool:
    digits = digits_of(text)
    return bool(issuer(digits)) and luhn(digits[:-1]) == int(digits[-1])


def _is_iban(text: str) -> bool:
    flat = text.replace(" ", "")
    return len(flat) >= 15 and iban_check(flat[:2], flat[4:]) == flat[2:4]


def _is_secret(text: str) -> bool:
    return any(map(str.isalnum, text))


def _fold(text: str) -> str:
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold())


def _span(m: re.Match, group: int) -> tuple[int, int]:
    """A name's place, without a possessive ending."""
    start, end = m.span(group)
    return start, end - 2 if m[group].endswith(("'s", "’s")) and end - start > 3 else end


def _people(text: str) -> list[tuple[int, int, str]]:
    """Names after forms of address, and where else in the text they stand."""
    found = [(_GENDER[m[1]], _span(m, 2), _span(m, 3) if m[3] else None) for m in _PERSON.finditer(text)]
    if not found:
        return []
    own = lambda span: _fold(text[slice(*span)])
    genders: dict[str, str] = {}
    for gender, first, last in found:
        if last and genders.get(own(first), "n") == "n":
            genders[own(first)] = gender
    families = {own(last) for _, _, last in found if last}
    out, names = [], {}
    for gender, first, last in found:
        given = bool(last) or own(first) in genders and own(first) not in families
        if gender == "n" and given:
            gender = genders[own(first)]
        out.append((*first, f"given-{gender}" if given else "family"))
        if last:
            out.append((*last, "family"))
    for start, end, kind in out:
        if names.setdefault(text[start:end], kind) != kind and kind == "family":
            names[text[start:end]] = kind
    known = {start for start, _, _ in out}
    for m in _WORD.finditer(text):
        start, end = _span(m, 0)
        if start not in known and (kind := names.get(text[start:end])):
            out.append((start, end, kind))
    return out


def detect(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of the text's entities, in order and without overlaps."""
    found: list[tuple[int, int, str]] = []
    add = lambda pattern, kind, good=None, group=0: found.extend((*m.span(group), kind) for m in pattern.finditer(text) if not good or good(m.group(group)))
    if "@" in text:
        add(_EMAIL, "email")
    if _DIGIT.search(text):
        add(_PHONE, "phone")
        add(_IPV4, "ipv4")
        add(_CARD, "card", _is_card)
        add(_SSN, "ssn")
        add(_IBAN, "iban", _is_iban)
    if _HINT.search(text):
        add(_SECRET, "secret", _is_secret, group=1)
    if "IA" in text:
        add(_ACCESS, "secret")
    found += _people(text)
    out, end = [], 0
    for item in sorted(found, key=lambda x: (x[0], -x[1], x[2])):
        if item[0] >= end:
            out.append(item)
            end = item[1]
    return out


#: Family names' endings in two forms (masculine, feminine) by script: the forms of one name are one entity.
INFLECTED = {"CYRILLIC": (("ский", "ская"), ("цкий", "цкая"), ("ов", "ова"), ("ев", "ева"), ("ёв", "ёва"), ("ин", "ина"), ("ын", "ына")), "LATIN": (("ski", "ska"), ("cki", "cka"), ("ov", "ova"), ("ev", "eva"))}


def neutral(name: str) -> str:
    """A folded family name in its first form."""
    for first, second in INFLECTED.get(script(name), ()):
        if name.endswith(second) and len(name) > len(second) + 1:
            return name[: -len(second)] + first
    return name


def canonical(kind: str, text: str) -> str:
    """What mentions of one entity have in common."""
    if kind == "family":
        return neutral(_fold(text))
    if kind == "email" or kind.startswith("given"):
        return _fold(text)
    if kind in ("phone", "card", "ssn"):
        return digits_of(text)
    if kind == "iban":
        return text.replace(" ", "")
    return text


# ---------------------------------------------------------------- keyed permutations

_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")
_CLASS_OF = {c: own for own in _CLASSES for c in own}
_HEX = "0123456789abcdef"


@lru_cache(10_000)
def alphabet(c: str, folded: bool = False) -> str:
    """The characters that may stand for one: its class; for letters and digits without one those of its category in its block of
    64 code points, with ``folded`` only such as case folding leaves alone; itself if it is no letter or digit."""
    if c in _CLASS_OF:
        return _CLASS_OF[c]
    if not c.isalnum():
        return c
    kind, base = unicodedata.category(c), ord(c) // 64 * 64
    own = "".join(x for x in map(chr, range(base, base + 64)) if unicodedata.category(x) == kind and (not folded or _fold(x) == x))
    return own if c in own else c


def _digest(key: bytes, *parts: object) -> int:
    return int.from_bytes(hmac.digest(key, "\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), "sha256"), "big")


def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size): a Feistel network over the next even number of bits, walked until it is in range."""
    if size < 2:
        return value
    half = (max(2, (size - 1).bit_length()) + 1) // 2
    mask = (1 << half) - 1

    def rounds(x: int) -> int:
        left, right = x >> half, x & mask
        for n in range(8):
            mixed = 0
            for block in range(-(-half // 256)):
                mixed = mixed << 256 | _digest(key, tweak, size, n, block, right)
            left, right = right, left ^ (mixed & mask)
        return left << half | right

    value = rounds(value)
    while value >= size:
        value = rounds(value)
    return value


def permute_text(text: str, key: bytes, tweak: str, alphabets: list[str] | None = None, folded: bool = False) -> str:
    """Permutes letters and digits among all strings of the same format; other characters stay.

    A longer text goes in pieces of PIECE characters, each under a tweak of all before it: still a permutation."""
    own = alphabets or [alphabet(c, folded) for c in text]
    out, before = [], 0
    for at in range(0, len(own), PIECE):
        piece = text[at : at + PIECE]
        out.append(_permute_piece(piece, own[at : at + PIECE], key, f"{tweak}|{at}|{before:x}" if at else tweak))
        before = _digest(key, "piece", before, piece)
    return "".join(out)


def _permute_piece(text: str, own: list[str], key: bytes, tweak: str) -> str:
    value, size = 0, 1
    for c, letters in zip(text, own):
        value, size = value * len(letters) + letters.index(c), size * len(letters)
    value = permute(value, size, key, tweak + "|" + "".join(a if len(a) == 1 else f"{a[0]}{len(a)}" for a in own))
    out = []
    for letters in reversed(own):
        value, k = divmod(value, len(letters))
        out.append(letters[k])
    return "".join(reversed(out))


# ---------------------------------------------------------------- surrogates

#: First octets of addresses with a use of their own; they stay.
_SPECIAL = {0, 10, 100, 127, 169, 172, 192, 198, 203} | set(range(224, 256))
_PUBLIC = [n for n in range(256) if n not in _SPECIAL]

#: Beginnings, middles and endings of names by script: of given names by gender, of family names, and what stands before an
#: inflected ending. Greek family names end by their form: the first list for those in -ς, the second for others.
SYLLABLES = {
    "LATIN": (("Ba", "Be", "Bo", "Ca", "Co", "Da", "De", "Do", "Fa", "Fe", "Ga", "Ha", "He", "Jo", "Ka", "Ke", "La", "Le", "Lo", "Ma", "Me", "Mi", "Na", "No", "Pa", "Pe", "Ra", "Re", "Ro", "Sa", "Se", "Ta", "Te", "To", "Va", "Vi", "Wa", "We"), ("la", "le", "li", "lo", "ma", "me", "mi", "na", "ne", "ni", "no", "ra", "re", "ri", "ro", "sa", "se", "si", "ta", "te", "ti", "va", "ve", "vi", "da", "de", "di"), {"m": ("n", "rd", "s", "ck", "rt"), "f": ("na", "la", "lle", "ra", "tta"), "n": ("m", "r", "l"), "family": ("mann", "ford", "son", "lier", "ner", "vez", "rini"), "joint": ("n", "r", "l", "w")}),
    "CYRILLIC": (("Ба", "Ве", "Го", "Да", "За", "Ка", "Ла", "Ма", "Ни", "Ро", "Са", "То"), ("ва", "ле", "ми", "но", "ра", "си", "та", "ду"), {"m": ("н", "р", "м"), "f": ("на", "ла", "ра"), "n": ("й", "ль"), "family": ("ленко", "нчук", "вич"), "joint": ("н", "р", "л", "т")}),
    "GREEK": (("Βα", "Γε", "Δη", "Ζα", "Κα", "Λα", "Μα", "Νι", "Πα", "Σα", "Τα"), ("λε", "μι", "νο", "ρα", "σι", "τα", "δο"), {"m": ("ος", "ης", "ας"), "f": ("να", "λα", "ρη"), "n": ("ις",), "family-ς": ("ιδης", "ακης"), "family": ("ιδου", "ακη")}),
}
#: Scripts whose names are made of letters of their own instead.
OTHER_SCRIPTS = ("CJK", "HANGUL", "HIRAGANA", "KATAKANA", "ARABIC", "HEBREW", "DEVANAGARI", "THAI")


def script(text: str) -> str:
    for c in text:
        if c.isalpha():
            first = unicodedata.name(c, "").split(" ")[0]
            return first if first in SYLLABLES or first in OTHER_SCRIPTS else "LATIN"
    return "LATIN"


def _name(kind: str, text: str, key: bytes, attempt: int) -> str:
    """A name of the text's script; each attempt has more names to choose from."""
    own = script(text)
    seed = _digest(key, kind, own, text, attempt)
    if own not in SYLLABLES:  # letters of the same script: the block of its first letter, by 64
        letters = alphabet(next(c for c in text if c.isalpha()))
        return "".join(letters[_digest(key, seed, k) % len(letters)] for k in range(len(text) + attempt))
    starts, middles, ends = SYLLABLES[own]
    parts = [starts[seed % len(starts)]]
    seed //= len(starts)
    for k in range(2 + attempt):
        parts.append(middles[seed % len(middles)])
        seed = seed // len(middles) if k < 40 else _digest(key, seed, k)
    if kind != "family":
        endings = ends[kind[-1]]
    elif form := next((first for first, _ in INFLECTED.get(own, ()) if text.endswith(first)), ""):
        endings = [joint + form for joint in ends["joint"]]
    else:
        endings = ends["family-ς" if own == "GREEK" and text.endswith(("ς", "σ")) else "family"]
    return "".join(parts) + endings[seed % len(endings)]


def _more(kind: str, own: str, attempt: int, key: bytes, letters: str) -> str:
    """Keyed characters that make a surrogate of an exhausted format longer: three more with each attempt."""
    n = 3 * max(0, attempt - FORMAT_ATTEMPTS + 1)
    return "".join(letters[_digest(key, "more", kind, own, attempt, k) % len(letters)] for k in range(n))


@lru_cache(100_000)
def surrogate(kind: str, own: str, attempt: int, key: bytes) -> str:
    """The surrogate of a canonical form, itself in canonical form but for a name's case."""
    tweak = f"{kind}|{attempt}"
    more = lambda letters: _more(kind, own, attempt, key, letters)
    if kind == "email":
        local, _, domain = own.partition("@")
        labels = domain.split(".")
        keep = 2 if labels[-2:-1] == ["example"] else 1  # a reserved domain stays reserved
        inner = ".".join(labels[:-keep])
        mixed_local, _, mixed_inner = permute_text(local + "@" + inner, key, tweak, folded=True).partition("@")
        return mixed_local + more(_CLASSES[1] + _CLASSES[0]) + "@" + ".".join(filter(None, [mixed_inner, *labels[-keep:]]))
    if kind in ("phone", "ssn"):
        return permute_text(own, key, tweak, ["0" if own[0] == "0" else "123456789", *_CLASSES[:1] * (len(own) - 1)]) + more(_CLASSES[0])
    if kind == "ipv4":
        octets = [int(x) for x in own.split(".")]
        first = octets[0]
        rest = octets[1] << 16 | octets[2] << 8 | octets[3]
        if first in _SPECIAL:
            rest = permute(rest, 1 << 24, key, f"{tweak}|{first}")
        else:
            first, rest = divmod(permute(_PUBLIC.index(first) << 24 | rest, len(_PUBLIC) << 24, key, tweak), 1 << 24)
            first = _PUBLIC[first]
        octet = lambda: "".join(f".{int(part, 36) % 256}" for part in re.findall("...", more(_CLASSES[0])))
        return f"{first}.{rest >> 16}.{rest >> 8 & 255}.{rest & 255}{octet()}"
    if kind == "card":
        prefix = issuer(own)
        digits = prefix + permute_text(own[len(prefix) : -1], key, tweak + prefix) + more(_CLASSES[0])
        return digits + str(luhn(digits))
    if kind == "iban":
        rest = permute_text(own[4:], key, tweak + own[:2]) + more(_CLASSES[0])
        return own[:2] + iban_check(own[:2], rest) + rest
    if kind == "secret":
        if _ACCESS.fullmatch(own):
            return own[:4] + permute_text(own[4:], key, tweak, [_CLASSES[0] + _CLASSES[2]] * 16) + more(_CLASSES[2])
        if re.fullmatch(r"[0-9a-f]{8,}", own):
            return permute_text(own, key, tweak, [_HEX] * len(own)) + more(_HEX)
        return permute_text(own, key, tweak) + more(_CLASSES[1] + _CLASSES[0])
    return _name(kind, own, key, attempt)


def _like(surrogate_text: str, kind: str, mention: str) -> str:
    """The surrogate in the mention's format: separators, digits' script, case, form of inflection; what is longer goes to the end."""
    if kind in ("phone", "card", "ssn"):
        digits = iter(surrogate_text)
        out = "".join(chr(ord(c) - unicodedata.decimal(c) + int(next(digits))) if c.isdecimal() else c for c in mention)
        return out + "".join(digits)
    if kind == "iban":
        letters = iter(surrogate_text)
        return "".join(c if c == " " else next(letters) for c in mention) + "".join(letters)
    if kind == "email":
        return surrogate_text.upper() if mention.isupper() else surrogate_text
    if kind == "family" and (folded := _fold(mention)) != (own := neutral(folded)):
        first, second = next((a, b) for a, b in INFLECTED[script(own)] if own.endswith(a))
        surrogate_text = surrogate_text[: -len(first)] + second
    if kind == "family" or kind.startswith("given"):
        return surrogate_text.upper() if mention.isupper() and len(mention) > 1 else surrogate_text.lower() if mention.islower() else surrogate_text
    return surrogate_text


def _check_key(kind: str, text: str) -> str:
    """What must differ between entities of a group: canonical forms, of all names in their first form."""
    return neutral(_fold(text)) if kind == "family" or kind.startswith("given") else canonical(kind, text)


#: Type to use and attempt of an entity (type, canonical form).
Attempts = Callable[[str, str], tuple[str, int]]


def rewrite(text: str | None, attempts: Attempts, key: bytes) -> tuple[str | None, list[str]]:
    """The text with surrogates, and the types of its entities in order."""
    if not text or not (found := detect(text)):
        return text, []
    out, at = [], 0
    for start, end, kind in found:
        mention = text[start:end]
        own = canonical(kind, mention)
        used, attempt = attempts(kind, own)
        out += [text[at:start], _like(surrogate(used, own, attempt, key), kind, mention)]
        at = end
    return "".join(out) + text[at:], [kind for _, _, kind in found]


# ---------------------------------------------------------------- over documents


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct (type, own): each entity's type and canonical form."""

    def run(rows: Iterator[tuple]) -> Iterable[tuple]:
        for (value,) in rows:
            if value:
                yield from {(kind, canonical(kind, value[a:b])) for a, b, kind in detect(value)}

    return map_rows(docs.select(text), run, "type string, own string", pa.schema([("type", pa.string()), ("own", pa.string())])).distinct()


_NAMED = "type string, own string, attempt int, group string, new string, original string"


def _named(pending: DataFrame, key: bytes) -> DataFrame:
    """Entities with their group, the check key of their surrogate, and that of themselves."""

    def run(rows: Iterator[tuple]) -> Iterable[tuple]:
        for kind, own, attempt in rows:
            group = "name" if kind == "family" or kind.startswith("given") else kind
            yield kind, own, attempt, group, _check_key(kind, surrogate(kind, own, attempt, key)), _check_key(kind, own)

    arrow = pa.schema([(n, pa.int32() if n == "attempt" else pa.string()) for n in ("type", "own", "attempt", "group", "new", "original")])
    return map_rows(pending.select("type", "own", "attempt"), run, _NAMED, arrow)


def assign(found: DataFrame, key: bytes, broadcast_entities: int = BROADCAST_ENTITIES) -> DataFrame:
    """(type, own, used, attempt) of distinct entities, such that no surrogate is another entity's surrogate or a detected original.

    ``used`` is the type whose surrogate they get: another one only for given names whose form of address tells no gender.
    A round tries the entities that have no surrogate yet against all that have one; these stay settled."""
    gendered = found.where("type in ('given-m', 'given-f')").groupBy("own").agg(F.max("type").alias("used"))
    aliases = cut(found.where("type = 'given-n'").join(gendered, "own").select("type", "own", "used"))
    pending = found.join(aliases, ["type", "own"], "left_anti").withColumn("attempt", F.lit(0).cast("int"))
    settled = originals = None
    while True:
        named = cut(_named(pending, key))
        n = named.count()
        if not n and settled is not None:
            break
        if originals is None:
            originals = named.select("group", F.col("original").alias("new")).distinct()
        tried = named.select("group", "new").distinct()
        small = F.broadcast(tried) if n <= broadcast_entities else tried
        taken = originals if settled is None else originals.union(settled.select("group", "new"))
        clash = taken.join(small, ["group", "new"]).distinct()
        free = named.join(F.broadcast(clash) if n <= broadcast_entities else clash, ["group", "new"], "left_anti")
        won = free.groupBy("group", "new").agg(F.min(F.struct("type", "own", "attempt")).alias("x")).select("x.*", "group", "new")
        won = cut(won)
        settled = won if settled is None else settled.union(won)
        pending = named.join(won, ["type", "own"], "left_anti").select("type", "own", (F.col("attempt") + 1).alias("attempt"))
    out = settled.select("type", "own", F.col("type").alias("used"), "attempt")
    like = settled.select(F.col("type").alias("used"), "own", "attempt")
    return out.union(aliases.join(like, ["used", "own"]).select("type", "own", "used", "attempt"))


def replace(docs: DataFrame, key: bytes, keep: tuple[str, ...] = ("doc_id",), text: str = "text", broadcast_entities: int = BROADCAST_ENTITIES) -> DataFrame:
    """Struct ``row`` of the kept columns, the rewritten ``text``, n_entities and their types."""
    if not key:
        raise ValueError("a key is needed")
    later = cut(assign(cut(entities(docs, text)), key, broadcast_entities).where("attempt > 0 or used <> type"))
    n = later.count()
    left = docs.select(F.struct(*keep).alias("row"), F.col(text).alias("text"))
    if n <= broadcast_entities:
        known = {(r["type"], r["own"]): (r["used"], r["attempt"]) for r in later.collect()}
        return _rewritten(left, known, key)
    # by text: each distinct text that needs later attempts gets its own list
    needs = entities_by_text(docs, text).join(later, ["type", "own"]).groupBy("digest").agg(F.collect_list(F.struct("type", "own", "used", "attempt")).alias("known"))
    joined = left.withColumn("digest", F.sha2("text", 256)).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(16)))
    needs = needs.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
    return _rewritten(joined.join(needs, ["digest", "salt"], "left").select("row", "text", "known"), None, key)


def entities_by_text(docs: DataFrame, text: str) -> DataFrame:
    """Distinct (digest of the text, type, own)."""

    def run(rows: Iterator[tuple]) -> Iterable[tuple]:
        for (value,) in rows:
            if value and (found := detect(value)):
                digest = hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest()
                yield from {(digest, kind, canonical(kind, value[a:b])) for a, b, kind in found}

    return map_rows(docs.select(text), run, "digest string, type string, own string", pa.schema([("digest", pa.string()), ("type", pa.string()), ("own", pa.string())])).distinct()


def _rewritten(left: DataFrame, known: dict | None, key: bytes) -> DataFrame:
    """With the entities' later attempts from one table, or from each row's own column ``known``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2).to_pylist() if known is None else [None] * len(batch)
            out = []
            for value, listed in zip(batch.column(1).to_pylist(), lists):
                table = {(x["type"], x["own"]): (x["used"], x["attempt"]) for x in listed or ()} if known is None else known
                out.append(rewrite(value, lambda kind, own, table=table: table.get((kind, own), (kind, 0)), key))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in out], pa.string()), pa.array([len(y) for _, y in out], pa.int64()), pa.array([",".join(y) for _, y in out], pa.string())], names=["row", "text", "n_entities", "entity_types"])

    return map_arrow(left, run, f"row {left.schema['row'].dataType.simpleString()}, text string, n_entities long, entity_types string")


#: Where the session names the query's key; the test tables are invented, so without one the query takes a public one.
KEY_SETTING, PUBLIC_KEY = "spark.sparkloom.surrogates.key", "no secret: for invented tables only"


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get(KEY_SETTING, PUBLIC_KEY).encode()
    return replace(load(spark, sf_dir, "documents"), key).select("row.doc_id", "text", "n_entities", "entity_types")


QUERIES = {"op3_surrogates": op3_surrogates}
ORACLE_SQL: dict[str, str] = {}
