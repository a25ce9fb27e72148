"""Personal data replaced by keyed surrogates.

Detected values (mail addresses, phone and card numbers, IP addresses of both
versions, bank and social security numbers, access keys, tokens, passwords, names after a title
and every further mention of their words in the same text) are replaced by
made-up values of the same type and form.

* *Coreference.*  Within a text a word of a name is one kind, whatever titles
  its mentions carry (a surname anywhere is a surname; else any title that
  tells a gender settles it), so all mentions get one surrogate.

* *Keyed and consistent.*  The surrogate of a value is a keyed permutation of
  all values of its form (a Feistel network over the value's letters and
  digits, each staying in its own alphabet), so a value has one surrogate in
  the whole corpus, whatever its case or punctuation, and two values never
  share one.  Names keep their gender, script, length and their order of
  vowels and consonants; known given names become other given names of the
  same gender.  Card numbers keep their check digit rule, addresses their range
  (private, loopback, link-local, multicast, public).  Letters beyond the fixed
  alphabets move among the letters of their own Unicode block, signs of a
  password among signs; a value in which nothing can move gets a keyed value of another form.
* *Collision check.*  A surrogate must not be a value that really occurs.  All
  distinct values of the corpus are joined with all surrogates; those that
  collide draw again under the next key until they are free and distinct.  In
  forms that the corpus fills densely, where draws rarely hit a free value,
  the free values are listed and numbered after ``TRIES`` draws, and the open
  values take them by number.  So the first draw, which is distinct, stands
  only where that list is used up.
  The few values that drew again reach their documents by a join that is
  broadcast only if Spark finds its table small.

Detection and replacement are map-only passes.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import secrets
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import count
from math import prod

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from recensio.operators.ordering import running_offset

from .common import cut, prepare, shared_folder, small_batches, table

#: The session setting that holds the secret key of the queries.
KEY_CONF = "spark.recensio.pii.key"
#: Draws before dense forms are numbered: those of at most ``DENSE`` values per value that occurs.
TRIES, DENSE = 8, 8
#: Values of a form listed by one row.
LISTED = 1 << 16

# ---- fixed values: titles, given names, alphabets --------------------------
TITLES = {"m": ["Mr", "Herr", "Herrn", "Señor", "Sr", "Monsieur", "господин", "κύριος"],
          "f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "госпожа", "κυρία"],
          "x": ["Dr", "Prof", "Professor"]}
GIVEN = {
    ("m", "latin"): "adam alan carlos daniel david eric felix frank georg henri hugo jack james jan john jorge karl leon louis luis marco mark martin max oscar paul peter robert simon thomas victor walter".split(),
    ("f", "latin"): "alice amelie anna barbara carla carmen clara diana elena emma eva helen ines irene jane julia karin laura linda lucia maria marie martha mary nina olga petra rosa sara sofia susan vera".split(),
    ("m", "cyrillic"): "андрей борис виктор дмитрий иван игорь максим михаил олег павел сергей юрий".split(),
    ("f", "cyrillic"): "анна вера галина елена ирина мария марина наталья ольга светлана софия юлия".split(),
    ("m", "greek"): "ανδρέας γιώργος δημήτρης κώστας μιχάλης νίκος πέτρος στέφανος".split(),
    ("f", "greek"): "άννα ελένη ειρήνη κατερίνα μαρία σοφία χριστίνα δήμητρα".split(),
}
VOWELS = {"latin": "aeiou", "accented": "àáâãäåèéêëìíîïòóôõöùúûü", "cyrillic": "аеиоуыэюя", "greek": "αεηιουω"}
CONSONANTS = {"latin": "bcdfghjklmnpqrstvwxyz", "accented": "çñßý", "cyrillic": "бвгджзйклмнпрстфхцчшщ", "greek": "βγδζθκλμνξπρστφχψ"}
DIGITS, HEX = "0123456789", "0123456789abcdef"
SIGNS = "!#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
# ----------------------------------------------------------------------------

_FIXED = {c: (s, v) for s in VOWELS for v, letters in ((True, VOWELS[s]), (False, CONSONANTS[s])) for c in letters}
_BASES = frozenset("".join(VOWELS.values()))


@lru_cache(maxsize=None)
def _block(number: int, category: str, vowels: bool | None) -> str:
    """Letters of one category in a block of 128 code points that are in no
    fixed alphabet; of the vowels or consonants among them, or all (None).
    Each is its own lower case, and its capital is one letter."""
    out = []
    for c in map(chr, range(number * 128, number * 128 + 128)):
        if unicodedata.category(c) == category and c not in _FIXED and c.lower() == c and len(c.upper()) == 1 and c.upper().lower() == c:
            if vowels is None or (unicodedata.normalize("NFD", c)[0] in _BASES) == vowels:
                out.append(c)
    return "".join(out)


def _beyond(c: str, apart: bool) -> str:
    """What may stand for a letter or digit of no fixed alphabet ('' if
    nothing may)."""
    category = unicodedata.category(c)
    if category == "Nd":
        zero = ord(c) - unicodedata.decimal(c)
        return "".join(map(chr, range(zero, zero + 10)))
    if category not in ("Ll", "Lo"):
        return ""
    letters = _block(ord(c) // 128, category, unicodedata.normalize("NFD", c)[0] in _BASES if apart else None)
    return letters if c in letters else ""


@lru_cache(maxsize=1 << 16)
def free(c: str) -> str:
    """The alphabet within which a character moves ('': it stays)."""
    if c in _FIXED:
        s = _FIXED[c][0]
        return VOWELS[s] + CONSONANTS[s]
    return DIGITS if c in DIGITS else _beyond(c, False)


@lru_cache(maxsize=1 << 16)
def named(c: str) -> str:
    """The same in names: vowels and consonants apart."""
    if c in _FIXED:
        s, vowel = _FIXED[c]
        return VOWELS[s] if vowel else CONSONANTS[s]
    return "" if c in DIGITS else _beyond(c, True)


def secret(c: str) -> str:
    """The same in passwords: signs move too."""
    return SIGNS if c in SIGNS else free(c)


def hexed(c: str) -> str:
    return HEX if c in HEX else ""


_HEX4 = "[0-9a-fA-F]{1,4}"
_GAP = r"[^\w\n]{0,6}"
_TITLE = "|".join(t for ts in TITLES.values() for t in ts)
_SPACE = r"[ \t\u00a0]"
PATTERN = re.compile(
    r"(?P<mail>(?<![\w.+-])[\w+-][\w.+-]*@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,})"
    r"|(?P<access>(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9]))"
    r"|(?:(?i:password|passwd|pwd)\s*[=:]\s*[\"']?(?P<password>[^\s\"']{4,}))"
    r"|(?:(?i:token|secret|api[_-]?key)[^\w\n]{1,8}(?P<token>[0-9A-Za-z_-]{16,}))"
    r"|(?P<hex>(?<![0-9A-Za-z])(?=[a-fA-F]*[0-9])[0-9a-fA-F]{32,}(?![0-9A-Za-z]))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    rf"|(?P<ip6>(?<![\w:.])(?:[23][0-9a-fA-F]{{3}}|[fF][c-fC-F][0-9a-fA-F]{{2}})(?:(?::{_HEX4}){{7}}|(?::{_HEX4}){{0,6}}::(?:{_HEX4}(?::{_HEX4}){{0,5}})?)(?![\w:]|\.\d))"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d))"
    rf"|(?P<phone>\+\d{{1,3}}{_GAP}\d{{2,4}}(?:{_GAP}\d{{2,4}}){{2,4}}(?!\d)|(?<!\d)\(\d{{3}}\){_GAP}\d{{3}}-\d{{4}}(?!\d)|(?<![\d-])\d{{3}}-\d{{3}}-\d{{4}}(?![\d-]))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<card>(?<!\d)(?:\d{4}(?P<gap>[ -]?)\d{4}(?P=gap)\d{4}(?P=gap)\d{4}|\d{13,19})(?!\d))"
    rf"|(?:\b(?P<title>(?:(?:{_TITLE})\.?{_SPACE}+)+)(?=[^\W\d_]))")
#: A word of a name: apostrophes inside belong to it, a closing 's does not.
_WORD = re.compile(r"(?<!\w)[^\W\d_]\w*(?:['’](?!s\b)[^\W\d_]\w*)*(?![\w.+-]*@)")
_JOIN = re.compile(rf"-|{_SPACE}+")
_INITIAL = re.compile(rf"\.?-|\.?{_SPACE}+|\.")
_NUMERIC = re.compile("[0-9@]")
_TITLED = re.compile(rf"(?:{_TITLE})\.?{_SPACE}")
_TITLES = tuple(t for ts in TITLES.values() for t in ts)
_SECRETS = ("token", "secret", "api", "passw", "pwd")


def hinted(text: str) -> bool:
    """Whether a text may hold anything: a quick look for what every pattern
    needs, by plain search first."""
    if _NUMERIC.search(text):
        return True
    low = text.casefold()
    return any(w in low for w in _SECRETS) or any(t in text for t in _TITLES) and _TITLED.search(text) is not None


def script_of(word: str) -> str:
    c = word[:1].lower()
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿" else "latin"


def _name(text: str, at: int, title: str) -> list[tuple[int, int, str, str]]:
    """The words of the name that begins at ``at``, as in ``find``: capitalised
    words and initials, joined by spaces or hyphens.  The last word, with what
    hyphens join to it, is the surname."""
    words = []  # (start, stop, whether a hyphen joins it to the word before)
    hyphen = False
    while (m := _WORD.match(text, at)) and m[0][0].isupper():
        short = len(m[0]) == 1
        go = (_INITIAL if short else _JOIN).match(text, m.end())
        follows = go and (n := _WORD.match(text, go.end())) and n[0][0].isupper()
        if short and words and not follows and text[m.end(): m.end() + 1] != ".":  # "Mr Smith I ..."
            break
        words.append((*m.span(), hyphen))
        if not follows:
            break
        at, hyphen = go.end(), go[0].endswith("-")
    if not words:
        return []
    last = max((i for i, (a, e, _) in enumerate(words) if e - a > 1), default=len(words) - 1)
    head = last
    while words[head][2]:
        head -= 1
    gender = next((g for g in "mf" if any(t.rstrip(".") in TITLES[g] for t in title.split())), None)
    out = []
    for i, (a, e, _) in enumerate(words):
        word, script = lowered(text[a:e]), script_of(text[a:e])
        part = "surname" if head <= i <= last else f"given-{gender or next((g for g in 'fm' if word in GIVEN.get((g, script), [])), 'x')}"
        out.append((a, e, f"{part}-{script}", word))
    return out


def _settled(found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """``found`` with one kind per word of a name: a surname if it is one
    anywhere, else a given name of the first gender a title or list tells."""
    kinds: dict[str, str] = {}
    for _, _, kind, value in found:
        part, _, rest = kind.partition("-")
        if part == "surname":
            kinds[value] = kind
        elif part == "given" and kinds.get(value, "given-x").startswith("given-x"):
            kinds[value] = kind
    return [(a, e, kinds.get(v, k) if k.startswith(("given-", "surname-")) else k, v) for a, e, k, v in found]


def _mentions(text: str, found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Further whole-word mentions of the words of detected names, outside
    ``found``."""
    known = {v: k for _, _, k, v in found if k.startswith(("given-", "surname-")) and len(v) > 1}
    if not known:
        return []
    out, k = [], 0
    for m in _WORD.finditer(text):
        kind = known.get(lowered(m[0]))
        if kind is None or not m[0][0].isupper():
            continue
        while k < len(found) and found[k][1] <= m.start():
            k += 1
        if k == len(found) or found[k][0] >= m.end():
            out.append((*m.span(), kind, lowered(m[0])))
    return out


def lowered(text: str) -> str:
    """Lower case, letter by letter: as long as the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _address6(raw: str) -> str | None:
    """An address in full, if it is one and names more than a network."""
    try:
        full = ipaddress.IPv6Address(raw).exploded
    except ValueError:
        return None
    return full if any(g != "0000" for g in full.split(":")[1:]) else None


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, stop, kind, value) of each detected value, in order.  value is
    the normal form: lower case, and letters and digits only where punctuation
    is mere layout."""
    out = []
    if not hinted(text):
        return out
    at = 0
    while m := PATTERN.search(text, at):
        at = m.end()
        kind = next(k for k, v in m.groupdict().items() if v is not None)
        if kind == "title":
            name = _name(text, at, m["title"])
            out += name
            at = name[-1][1] if name else at
            continue
        if kind == "ip6":
            if full := _address6(m[0]):
                out.append((*m.span(), "ip6", full))
            continue
        kind = "token" if kind == "hex" else kind
        start, stop = m.span(kind if m[kind] is not None else "hex") if kind != "token" else m.span("token" if m["token"] is not None else "hex")
        raw = text[start:stop]
        plain = lowered(raw)
        value = "".join(c for c in plain if c.isalnum()) if kind in ("phone", "card", "ssn", "iban") else plain
        out.append((start, stop, kind, value))
    out = _settled(out)
    more = _mentions(text, out)
    return sorted(out + more) if more else out


# ---- the keyed permutation -------------------------------------------------

def _shuffle(digits: list[int], sizes: list[int], seed: bytes) -> list[int]:
    """A permutation of all digit strings with these sizes: Feistel rounds
    with modular addition between the two halves."""
    half = len(digits) // 2
    if not half:
        if not digits:
            return digits
        h = int.from_bytes(hashlib.blake2b(b"1", key=seed).digest(), "big")
        return [(digits[0] + h) % sizes[0]]

    def number(d, s):
        n = 0
        for x, k in zip(d, s):
            n = n * k + x
        return n

    def spread(n, s):
        out = []
        for k in reversed(s):
            n, x = divmod(n, k)
            out.append(x)
        return out[::-1]

    sl, sr = sizes[:half], sizes[half:]
    nl, nr = 1, 1
    for k in sl:
        nl *= k
    for k in sr:
        nr *= k
    left, right = number(digits[:half], sl), number(digits[half:], sr)
    for r in range(4):
        f = lambda v, side: int.from_bytes(hashlib.blake2b(b"%d %s %d" % (r, side, v), key=seed).digest(), "big")
        left = (left + f(right, b"l")) % nl
        right = (right + f(left, b"r")) % nr
    return spread(left, sl) + spread(right, sr)


def _luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _permuted(value: str, alphabet: Callable[[str], str], seed: bytes, moves: list[int]) -> str:
    """The value with the characters at ``moves`` moved within their own
    alphabets."""
    sets = [alphabet(value[i]) for i in moves]
    digits = _shuffle([a.index(value[i]) for i, a in zip(moves, sets)], [len(a) for a in sets], seed)
    out = list(value)
    for i, d, a in zip(moves, digits, sets):
        out[i] = a[d]
    return "".join(out)


# ---- address ranges ----

def _range(a: list[int]) -> tuple[tuple[int, int], ...]:
    """The range an address of version 4 stays in, as (first, size) per part."""
    byte = (0, 256)
    if a[0] in (0, 10, 127):
        return ((a[0], 1), byte, byte, byte)
    if a[0] == 172 and 16 <= a[1] < 32:
        return ((172, 1), (16, 16), byte, byte)
    if a[:2] in ([192, 168], [169, 254]):
        return ((a[0], 1), (a[1], 1), byte, byte)
    return ((224, 32) if a[0] >= 224 else (1, 223), byte, byte, byte)


def _groups(value: str) -> list[int]:
    """Places of the digits of an address of version 6 that move: those of
    groups that are not zero, but for the first."""
    return [i for g in range(1, 8) if value[5 * g:5 * g + 4] != "0000" for i in range(5 * g, 5 * g + 4)]


# ---- forms ----

def _form(kind: str, value: str) -> tuple[str, Callable[[str], str], list[int]]:
    """(tag, alphabets, places that move) of a value that is no address and
    no listed given name.  Tag: v and x are card numbers that keep and break
    the check digit rule, h hexadecimal."""
    part = kind.partition("-")[0]
    tag, alphabet = "-", named if part in ("given", "surname") else secret if part == "password" else free
    if part == "card" and value.isdecimal() and value.isascii():
        tag = "v" if _luhn(value) else "x"
    elif part in ("token", "password") and value and all(c in HEX for c in value):
        tag, alphabet = "h", hexed
    return tag, alphabet, _moves(part, value, alphabet)


def _moves(part: str, value: str, alphabet: Callable[[str], str]) -> list[int]:
    fixed = {"access": 4, "iban": 2, "phone": 1 if len(value) > 10 else 0}.get(part, 0)
    stop = max(0, value.rfind(".")) if part == "mail" else len(value)  # the last label of a mail address stays
    return [i for i in range(fixed, stop) if len(alphabet(value[i])) > 1]


def _least(value: str, alphabet: Callable[[str], str], moves: list[int]) -> str:
    out = list(value)
    for i in moves:
        out[i] = alphabet(value[i])[0]
    return "".join(out)


def _pool(kind: str) -> list[str]:
    part, _, rest = kind.partition("-")
    return GIVEN.get(tuple(rest.split("-")), []) if part == "given" else []


def surrogate(kind: str, value: str, key: str, draw: int = 0) -> str:
    """The normal form that stands for a normal form.  For each key and draw
    it is a permutation of the values of one kind and form; a value in which
    nothing can move gets letters from a keyed hash instead."""
    def seed(form: str) -> bytes:
        return hashlib.blake2b(f"{key}\0{draw}\0{kind}\0{form}".encode("utf-8", "surrogatepass"), digest_size=32).digest()

    def walk(step, same):
        """Permute within the values for which ``same`` holds (it holds for
        the value itself): go on along its cycle until one is met again."""
        v = step(value)
        while not same(v):
            v = step(v)
        return v

    if kind == "ip":
        own = _range(list(map(int, value.split("."))))

        def step(v):
            d = _shuffle([x - low for x, (low, _) in zip(map(int, v.split(".")), own)], [n for _, n in own], seed(str(own)))
            return ".".join(str(x + low) for x, (low, _) in zip(d, own))
        return walk(step, lambda v: _range(list(map(int, v.split(".")))) == own)
    if kind == "ip6":
        moves = _groups(value)
        return walk(lambda v: _permuted(v, hexed, seed(f"{value[:4]} {moves}"), moves), lambda v: _groups(v) == moves)
    pool = _pool(kind)
    if value in pool:
        return pool[_shuffle([pool.index(value)], [len(pool)], seed("pool"))[0]]
    tag, alphabet, moves = _form(kind, value)
    if not moves:
        h = hashlib.blake2b(value.encode("utf-8", "surrogatepass"), key=seed("none"), digest_size=14).digest()
        return "".join((VOWELS if i % 2 else CONSONANTS)["latin"][x % (5 if i % 2 else 21)] for i, x in enumerate(h))
    step = lambda v: _permuted(v, alphabet, seed(tag + _least(v, alphabet, moves)), moves)
    if tag in "vx":
        return walk(step, lambda v: _luhn(v) == (tag == "v"))
    return walk(step, lambda v: v not in pool)


def space(kind: str, value: str) -> tuple[str, int, int]:
    """(form, strings, values): the values that ``surrogate`` permutes along
    with this one are those ``member(kind, form, i)``, i < strings, that are
    not None; ``values`` is about their number."""
    if kind == "ip":
        own = _range(list(map(int, value.split("."))))
        size = prod(n for _, n in own)
        return "i" + " ".join(f"{low} {n}" for low, n in own), size, size
    if kind == "ip6":
        moves = _groups(value)
        return "6" + "".join("f" if i in moves else c for i, c in enumerate(value)), 16 ** len(moves), 65535 ** (len(moves) // 4)
    if value in (pool := _pool(kind)):
        return "p", len(pool), len(pool)
    tag, alphabet, moves = _form(kind, value)
    if not moves:
        return "n", 0, 1 << 62  # never listed
    size = prod(len(alphabet(value[i])) for i in moves)
    return tag + _least(value, alphabet, moves), size, {"v": size // 10, "x": size - size // 10}.get(tag, size)


def member(kind: str, form: str, i: int) -> str | None:
    """The i-th string of a form (see ``space``); None if it is no value."""
    tag, value = form[0], form[1:]
    if tag == "i":
        n = list(map(int, value.split()))
        out = []
        for low, size in reversed(list(zip(n[::2], n[1::2]))):
            i, d = divmod(i, size)
            out.append(d + low)
        out.reverse()
        return ".".join(map(str, out)) if _range(out) == tuple(zip(n[::2], n[1::2])) else None
    pool = _pool(kind)
    if tag == "p":
        return pool[i]
    if tag == "6":
        alphabet, moves = hexed, _groups(value)
    else:
        alphabet = hexed if tag == "h" else _form(kind, value)[1]
        moves = _moves(kind.partition("-")[0], value, alphabet)
    out = list(value)
    for at in reversed(moves):
        letters = alphabet(out[at])
        i, d = divmod(i, len(letters))
        out[at] = letters[d]
    out = "".join(out)
    return None if out in pool or tag in "vx" and _luhn(out) != (tag == "v") or tag == "6" and _groups(out) != moves else out


def fill(raw: str, kind: str, stands: str) -> str:
    """The surrogate in the written form of ``raw``: its case and layout."""
    if kind == "ip":
        return stands
    if kind == "ip6":
        if len(raw) < len(stands):
            stands = ipaddress.IPv6Address(stands).compressed
        return stands.upper() if raw.isupper() else stands
    if kind in ("phone", "card", "ssn", "iban") and len(stands) == sum(map(str.isalnum, raw)):
        it = iter(stands)
        stands = "".join(next(it) if c.isalnum() else c for c in raw)
    if len(stands) != len(raw):  # another given name
        return stands.upper() if raw.isupper() and len(raw) > 1 else stands[:1].upper() + stands[1:] if raw[:1].isupper() else stands
    return "".join(s.upper() if r.isupper() and len(s.upper()) == 1 else s for s, r in zip(stands, raw))


def replace(text: str, key: str, again: dict[tuple[str, str], str] | None = None, memo=None) -> tuple[str, list[tuple[int, int, str]]]:
    """(text with surrogates, (start, stop, kind) of each in it)."""
    found = find(text)
    if not found:
        return text, []
    out, spans, at, size = [], [], 0, 0
    for start, stop, kind, value in found:
        stands = (again or {}).get((kind, value)) or (memo or surrogate)(kind, value, key)
        new = fill(text[start:stop], kind, stands)
        out += [text[at:start], new]
        size += start - at
        spans.append((size, size + len(new), kind))
        size += len(new)
        at = stop
    out.append(text[at:])
    return "".join(out), spans


# ---- operator --------------------------------------------------------------

def text_hash(text):
    """Names a text's list of values drawn again.  Were two texts to share a
    hash, each would get the other's list besides its own, which changes
    nothing."""
    return F.xxhash64(text)


def entities(docs: DataFrame) -> DataFrame:
    """(h, kind, value) of every detected value, once per text; h is the
    text's hash."""
    rows = docs.select(text_hash(F.col("text")).alias("h"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            row, kind, value = [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                for k, v in sorted({x[2:] for x in find(text)}):
                    row.append(i)
                    kind.append(k)
                    value.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(kind, pa.string()), pa.array(value, pa.string())], ["h", "kind", "value"])

    return rows.mapInArrow(run, "h long, kind string, value string").distinct()


def _drawn(values: DataFrame, key: str, draw: int) -> DataFrame:
    """(kind, value, stands) of one draw."""
    def run(batches):
        for b in batches:
            stands = [surrogate(k, v, key, draw) for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(stands, pa.string())], ["kind", "value", "stands"])

    return values.select("kind", "value").mapInArrow(run, "kind string, value string, stands string")


def _spaced(values: DataFrame) -> DataFrame:
    """(kind, value, form, strings, size) by ``space``."""
    def run(batches):
        for b in batches:
            got = [space(k, v) for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            numbers = [pa.array([min(g[i], 1 << 62) for g in got], pa.int64()) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0] for g in got], pa.string()), *numbers], ["kind", "value", "form", "strings", "size"])

    return values.select("kind", "value").mapInArrow(run, "kind string, value string, form string, strings long, size long")


def _listed(forms: DataFrame, key: str) -> DataFrame:
    """(kind, form, stands, mark): all values of ``forms(kind, form, strings)``;
    mark orders them by the key."""
    rows = forms.select("kind", "form", "strings", F.explode(F.expr(f"sequence(0L, (strings - 1) div {LISTED})")).alias("part")).repartition("kind", "form", "part")

    def run(batches):
        seed = hashlib.blake2b(f"{key}\0order".encode(), digest_size=32).digest()
        for b in batches:
            for row in b.to_pylist():
                kind, form, first = row["kind"], row["form"], row["part"] * LISTED
                got = [v for i in range(first, min(first + LISTED, row["strings"])) if (v := member(kind, form, i)) is not None]
                marks = [int.from_bytes(hashlib.blake2b(v.encode(), key=seed, digest_size=8).digest(), "big", signed=True) for v in got]
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(got), pa.string()), pa.array([form] * len(got), pa.string()), pa.array(got, pa.string()), pa.array(marks, pa.int64())],
                                                 ["kind", "form", "stands", "mark"])

    return rows.mapInArrow(run, "kind string, form string, stands string, mark long")


def drawn_again(values: DataFrame, key: str, tries: int = TRIES) -> DataFrame | None:
    """(kind, value, stands) of the distinct ``values(kind, value)`` whose
    first surrogate really occurs and whose form has a free value for them;
    None if no first surrogate occurs."""
    first = cut(_drawn(values, key, 0))
    real = values.select("kind", F.col("value").alias("stands"))
    open_ = cut(first.join(real, ["kind", "stands"], "left_semi").select("kind", "value"))
    used = first.select("kind", "stands")
    done = None

    def settle(new: DataFrame) -> DataFrame:
        """Of (kind, value, stands), those that are free, each for one value."""
        nonlocal done, used
        free = new.join(real, ["kind", "stands"], "left_anti").join(used, ["kind", "stands"], "left_anti")
        won = cut(free.groupBy("kind", "stands").agg(F.min("value").alias("value")).select("kind", "value", "stands"))
        done = won if done is None else cut(done.unionByName(won))
        used = used.unionByName(won.select("kind", "stands"))
        return won

    for draw in count(1):
        if open_.isEmpty():
            break
        if draw == tries + 1:
            held = cut(_spaced(open_))
            forms = _spaced(values).join(held.select("kind", "form").distinct(), ["kind", "form"], "left_semi").groupBy("kind", "form").agg(
                F.count("*").alias("n"), F.max("strings").alias("strings"), F.max("size").alias("size"))
            dense = cut(forms.where(F.col("size") <= F.col("n") * DENSE).select("kind", "form", "strings"))
            open_ = cut(held.join(dense, ["kind", "form"], "left_anti").select("kind", "value"))
            held = held.join(dense, ["kind", "form"], "left_semi").select("kind", "form", "value")
            every = cut(_listed(dense, key))
            while not held.isEmpty():
                free = every.join(real, ["kind", "stands"], "left_anti").join(used, ["kind", "stands"], "left_anti")
                free = running_offset(free, ["mark", "stands"], F.lit(1), ["kind", "form"], "number")
                asked = running_offset(held, ["value"], F.lit(1), ["kind", "form"], "number")
                won = settle(asked.join(free, ["kind", "form", "number"]).select("kind", "value", "stands"))
                if won.isEmpty():  # no form of an open value has a free one
                    break
                held = cut(held.join(won, ["kind", "value"], "left_anti"))
            continue
        won = settle(_drawn(open_, key, draw))
        open_ = cut(open_.join(won, ["kind", "value"], "left_anti"))
    return done


def key_of(spark: SparkSession) -> str:
    """The session's secret key (``KEY_CONF``); without one, a new random key:
    consistent within the run, and nobody can undo it."""
    return spark.conf.get(KEY_CONF, None) or secrets.token_hex(16)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", check: bool = True) -> DataFrame:
    """All columns of ``docs`` in a struct ``row``; text, with surrogates; and
    spans (array of start, stop, kind: where they stand in it).

    Null texts stay null and empty ones empty.  Rows keep their number;
    repeated rows get the same surrogates.  Null ids are kept; rows that share
    an id are handled each for itself.  Other columns may have any name.  Texts
    of any length are read whole.  An empty table gives an empty result.
    """
    if not key:
        raise ValueError("surrogates need a secret key")
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).cast("string").alias("text"))
    again = None
    if check:
        mine = cut(entities(rows))
        again = drawn_again(cut(mine.select("kind", "value").distinct()), key)
    pair = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("kind", "value", "stands")]))
    if again is None or again.isEmpty():
        rows = rows.select("row", "text", F.lit(None).cast(pair).alias("again"))
    else:
        # written, so that Spark knows its size when it plans the join
        path = shared_folder(spark, "again")
        mine.join(again, ["kind", "value"]).groupBy("h").agg(F.collect_list(F.struct("kind", "value", "stands")).alias("again")).write.parquet(path)
        rows = rows.withColumn("_h", text_hash(F.col("text"))).join(spark.read.parquet(path), F.col("_h") == F.col("h"), "left").select("row", "text", "again")
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("kind", T.StringType())]))
    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType()), T.StructField("spans", span)])

    def run(batches):
        memo = lru_cache(maxsize=50_000)(surrogate)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string())]))
        for b in small_batches(batches):
            texts, spans = [], []
            for text, more in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                new, at = (None, []) if text is None else replace(text, key, {(x["kind"], x["value"]): x["stands"] for x in more or []}, memo)
                texts.append(new)
                spans.append([{"start": s, "stop": e, "kind": k} for s, e, k in at])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(spans, kind)], ["row", "text", "spans"])

    return rows.mapInArrow(run, schema)


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates; edge cases as in ``pseudonymise``."""
    out = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key_of(spark))
    return out.select("row.doc_id", "text", F.size("spans").cast("long").alias("n_entities"), "spans")
