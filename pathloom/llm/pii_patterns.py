"""Where personal information may be in a text: spans by pattern, and candidates for names."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from functools import lru_cache

import ahocorasick
import regex

# ---- fixed values: words of the languages handled (English, German, French, Spanish) ----------

STREET_EN = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Way|Court|Ct|Terrace|Ter|Boulevard|Blvd|Drive|Dr|Place|Pl|Square|Sq|Close|Crescent|Row|Parkway|Pkwy|Highway|Hwy|Circle|Cir|Alley|Walk|Gardens|Grove|Mews|Hill"
STREET_DE = "straße|strasse|str\\.|weg|allee|platz|gasse|ring|damm|ufer|steig|pfad|zeile|graben|wall|markt"
PLACE_DE = "Am|An der|An den|An dem|Auf der|Auf dem|Im|In der|In den|Zum|Zur|Unter den|Hinter der|Hinter dem|Vor dem"
STREET_FR = "rue|avenue|av\\.?|boulevard|boul\\.|bd\\.?|chemin|ch\\.|place|pl\\.|allée|all\\.|impasse|imp\\.|quai|route|square|cours|passage|ruelle|sentier|villa"
STREET_ES = "C/|C\\.|Calle|Avda\\.?|Av\\.|Avenida|Paseo|P\\.º|Pº|Plaza|Pza\\.|Plza\\.|Ronda|Camino|Cno\\.|Carretera|Ctra\\.|Travesía|Glorieta|Pasaje|Callejón"
PARTICLES = "van der|van den|van de|van|von der|von|vom|zu|zum|zur|de la|de las|de los|de|del|della|di|da|dos|das|du|des|le|la|el|al|bin|ibn|ter|ten|af|av"
TITLES = "Dr|Prof|Mr|Mrs|Ms|Mx|Miss|Sir|Herr|Herrn|Frau|Hr|Fr|M|Mme|Mlle|Sr|Sra|Srta|Don|Doña|Señor|Señora|Ing|Dipl"
#: Titles that are hardly ever anything else.
PLAIN_TITLES = ("dr", "prof", "mr", "mrs", "ms", "mx", "herr", "herrn", "frau", "mme", "mlle", "sra", "srta", "doña", "señor", "señora")
ID_LABELS = (
    "SSN|social security(?: number| no\\.?)?|social insurance(?: number| no\\.?)?|national insurance(?: number| no\\.?)?|NINO|NI number|tax(?:payer)? id(?:entification)?(?: number| no\\.?)?|TIN|ITIN"
    "|passport(?: number| no\\.?)?|national id(?:entity)?(?: card)?(?: number| no\\.?)?|identity (?:card )?(?:number|no\\.?)|personal id(?:entity)?(?: number| no\\.?)?"
    "|Steuer-?(?:ID|Id|Identifikationsnummer|nummer)|Steueridentifikationsnummer|IdNr\\.?|Sozialversicherungsnummer|SV-Nummer|Reisepass(?:nummer)?|Pass(?:nummer|-Nr\\.?)|Personalausweis(?:nummer)?|Ausweis(?:nummer|-Nr\\.?)"
    "|NIR|numéro de sécu(?:rité sociale)?|n° de sécu(?:rité sociale)?|sécurité sociale|numéro fiscal|passeport(?: n°)?|carte d'identité(?: n°)?"
    "|DNI|NIF|NIE|número de la seguridad social|seguridad social|pasaporte|CIF|CURP"
)
#: Ends of a domain that name a unit of a service manager, not a host.
UNIT_ENDS = "service|socket|timer|target|mount|path|slice|scope|device"
PHONE_LABELS = "phone|tel|telephone|mobile|cell|fax|pager|call|sms|telefon|téléphone|teléfono|handy"

# -----------------------------------------------------------------------------------------------

_FLAT = {ord(c): "-" for c in "‐‑‒–—−﹣-"} | {ord(c): " " for c in "               　\t"} | {ord(c): "'" for c in "’ʼ`´"} | {0xFF20: "@", 0xFF0E: "."} | {0xFF10 + i: str(i) for i in range(10)}

_AT = r"(?:@|[ ]?[\[({<][ ]?(?:at|AT|@|arroba)[ ]?[\])}>][ ]?|[ ]@[ ]|[ ](?:AT|at)[ ](?=[\p{L}\d-]+[ ](?:dot|DOT)[ ]))"
_DOT = r"(?:\.|[ ]?[\[({<][ ]?(?:dot|DOT|punkt|point|punto|\.)[ ]?[\])}>][ ]?|[ ](?:dot|DOT)[ ])"
EMAIL = regex.compile(rf"(?<![\p{{L}}\p{{M}}\d._%+\-@/])([\p{{L}}\d](?:[\p{{L}}\p{{M}}\d._%+\-]*[\p{{L}}\p{{M}}\d_%+\-])?){_AT}((?:[\p{{L}}\d](?:[\p{{L}}\d\-]*[\p{{L}}\d])?{_DOT})+)(\p{{L}}{{2,24}})(?![\p{{L}}\d\-@]|\.\d)")
# what every address has somewhere, and texts in lower case without which there is none
MAIL_HINTS = ("@", " dot ", "at]", "at)", "at}", "at>", "at ]", "at )", "at }", "at >", "arroba")
MAIL_SIGN = re.compile(r"@|[\[({<][ ]?(?:at|AT|arroba)[ ]?[\])}>]|[ ](?:at|AT)[ ](?:[^\W_]|-)+[ ](?:dot|DOT)[ ]")
# the characters of a local part, backwards from the sign
_LOCAL_BACK = regex.compile(r"(?r)[\p{L}\p{M}\d._%+\-]*")
_NOT_MAIL = regex.compile(rf"^(?:{UNIT_ENDS})$", regex.I)

_SEP = r"[\s.\-]?"
PHONE = regex.compile(
    r"(?<![\p{L}\d_@#]|[\d][.,\-/+]|\b[vV]\.?)"
    r"(?:"
    r"\+\d{1,3}[\s.\-]?(?:\(0\)[\s.\-]?)?(?:\(?\d{1,5}\)?[\s.\-/]{0,2}){1,6}\d"
    r"|00\d{2}[\s.\-]?(?:\(0\)[\s.\-]?)?(?:\d{1,5}[\s.\-/]?){1,6}\d"
    r"|(?:1[\s.\-])?\(\d{3}\)\s?\d{3}[\s.\-]?\d{4}"
    r"|(?:1[\s.\-])?\d{3}([\s.\-])\d{3}\1\d{4}"
    r"|\(0\d{2,5}\)\s?\d{3,8}(?:[\s\-]\d{1,5})?"
    r"|0\d{2,4}[\s/\-]\s?\d{3,8}(?:[\s\-]\d{1,5})?"
    r"|0[1-9](?:([\s.\-])\d{2})(?:\2\d{2}){3}"
    r"|[6789]\d{2}([\s.\-])\d{3}\3\d{3}"
    r"|[6789]\d{2}([\s.\-])\d{2}\4\d{2}\4\d{2}"
    r")(?![\d_]|[.\-/,]\d|\p{L})"
)
_ASSIGNED = regex.compile(r"([\p{L}_]+)\s?=\s?[\"']?$")
_PHONE_LABEL = regex.compile(rf"(?:{PHONE_LABELS})$", regex.I)

_LABEL_GAP = r"(?:\s|[:=#\"']|\bn(?:o|r|um)?\.|n\.?[º°o]|nº|n°|\bnumber\b|\bnumbers\b|\bno\b|\bnr\b|\bis\b|\bist\b|\blautet\b|\bes\b|\best\b|\bvon\b)*"
_NUMBER = (
    r"(?:\d{3}[\- ]\d{2}[\- ]\d{4}|\d{9}"
    r"|\p{Lu}{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?\p{Lu}"
    r"|\d{2}\s\d{3}\s\d{3}\s\d{3}|\d{11}"
    r"|[12]\s\d{2}\s\d{2}\s(?:\d{2}|2[AB])\s\d{3}\s\d{3}(?:\s\d{2})?|[12]\d{12}(?:\s?\d{2})?"
    r"|\d{2}\.?\d{3}\.?\d{3}[\- ]?\p{Lu}|[XYZ][\- ]?\d{7}[\- ]?\p{Lu}"
    r"|\p{Lu}{1,2}\d{6,8}|\p{Lu}\d{2}\p{Lu}{2}\d{5}|\d{2}\s?\d{6}\s?\p{Lu}\s?\d{3})(?![\p{L}\d]|-\d)"
)
# what labels begin with: the whole pattern is tried there only
ID_STEMS = (
    "ssn", "social security", "social insurance", "national insurance", "nino", "ni number", "tax", "tin", "itin", "passport", "national id", "identity", "personal id",
    "steuer", "idnr", "sozialversicherungsnummer", "sv-nummer", "reisepass", "pass", "personalausweis", "ausweis",
    "nir", "numéro de sécu", "n° de sécu", "sécurité sociale", "numéro fiscal", "passeport", "carte d'identité",
    "dni", "nif", "nie", "número de la seguridad social", "seguridad social", "pasaporte", "cif", "curp",
)
ID_NUMBER = regex.compile(rf"(?<![\p{{L}}\d])(?:{ID_LABELS}){_LABEL_GAP}(?<![\p{{L}}\d])({_NUMBER})", regex.I)
#: Fixed value: letters that begin a British insurance number as published, and the pair used in examples.
NINO = r"(?:[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]|QQ)"
# told without a label; the part that is looked for begins with something rare
_SSN_TAIL = re.compile(r"-\d\d-\d{4}(?![^\W_]|[.\-/]\d)")
_NINO = re.compile(rf"{NINO}\s?\d\d\s?\d\d\s?\d\d\s?[A-D](?![^\W_]|[.\-/]\d)")
_FREE_BEFORE = re.compile(r"(?<![^\W_])(?<![.\-/+])")

_WORD = r"\p{Lu}[\p{L}\p{M}']*(?:-\p{L}[\p{L}\p{M}']+)*"
ADDRESS = regex.compile(
    rf"(?<![\p{{L}}\d.,\-/#])(?:"
    rf"\d{{1,5}}(?:-\d{{1,5}})?\s?[A-Za-z]?,?\s+(?:{_WORD}\.?\s+){{1,4}}?(?:{STREET_EN}|{STREET_EN.upper()})\b(?!\s?=)"
    rf"|\d{{1,4}}(?:\s?(?:bis|ter|quater|[A-Da-d]))?,?\s+(?:{STREET_FR})\s+(?:(?:de|du|des|la|le|les|à|aux|au|d'|l'|sur|et)\s*)*{_WORD}"
    rf"|(?:{STREET_ES})\s+(?:(?:de|del|la|las|los|el|y)\s+)*{_WORD}(?:\s+(?:(?:de|del|la|las|los|y)\s+)*{_WORD}){{0,3}},?\s+(?:n\.?[º°]|núm\.?|no\.|número)?\s?\d{{1,4}}\b"
    rf"|\p{{Lu}}[\p{{L}}\-]*+\.?(?<={STREET_DE})\s+\d{{1,4}}\s?[a-z]?\b"
    rf"|{_WORD}\s+(?i:{STREET_DE})\s+\d{{1,4}}\s?[a-z]?\b"
    rf"|(?:{PLACE_DE})\s+(?:{_WORD}\s+){{1,3}}\d{{1,4}}\s?[a-z]?\b(?=[\s.,;:)\"'\]|]|$)"
    rf")"
)

_CAP_PART = r"\p{Lu}[\p{L}\p{M}]*(?:'\p{L}[\p{L}\p{M}]*)?"
CAP = rf"{_CAP_PART}(?:-{_CAP_PART})*"
_PARTICLE = rf"(?i:{PARTICLES})"
NAME = rf"(?!{_PARTICLE}[^\p{{L}}]){CAP}"
_INITIAL = r"\p{Lu}\.(?:-?\p{Lu}\.)?"
_START, _END = r"(?<![\p{L}\p{M}\d_@\-+/\\#$%])(?<!\p{L}')", r"(?![\p{L}\p{M}\d_@/\\(]|['\-.+]\p{L}|=)"
FULL = regex.compile(rf"{_START}({NAME})\s{{1,3}}(?:{_INITIAL}\s{{0,2}}){{0,2}}({_PARTICLE}\s)?({NAME}){_END}")
SHORT = regex.compile(rf"{_START}{_INITIAL}\s{{0,2}}(?:{_INITIAL}\s{{0,2}})?({_PARTICLE}\s)?({NAME}){_END}")
TURNED = regex.compile(rf"{_START}({NAME}),\s{{1,2}}({NAME}|{_INITIAL})(?![\p{{L}}\d_@])")
TITLED = regex.compile(rf"(?<![\p{{L}}\d_])(?:{TITLES})\.?\s{{1,2}}(?:(?:{TITLES})\.?\s{{1,2}}){{0,2}}({_PARTICLE}\s)?({NAME}){_END}")
TOKEN = regex.compile(rf"{_START}({CAP})(?![\p{{L}}\d_])")
_BEFORE = regex.compile(rf"{_START}({_PARTICLE})\s$")
_BY = regex.compile(r"\b[Gg]e\p{L}+(?:t|en)\s+$")
_PARTS = regex.compile(r"[\p{L}]{3,}")


_FLAT = {chr(c): v for c, v in _FLAT.items()}
_ODD = re.compile("[" + "".join(map(re.escape, _FLAT)) + "]")


def flat(text: str) -> str:
    """The text with unusual dashes, blanks and digits as usual ones; as long as before."""
    return _ODD.sub(lambda m: _FLAT[m[0]], text)


@lru_cache(maxsize=1)
def _stems() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for w in ID_STEMS:
        found.add_word(w, len(w))
    found.make_automaton()
    return found


def _lower(text: str) -> str:
    """Lower case, as long as before."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Places:
    """Intervals of a text that don't overlap, in order."""

    def __init__(self, spans=()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if not self.starts or a >= self.ends[-1]:
                self.starts.append(a)
                self.ends.append(b)
            else:
                self.ends[-1] = max(b, self.ends[-1])

    def free(self, a: int, b: int) -> bool:
        """Whether [a, b) meets none of them."""
        i = bisect_left(self.starts, b)
        return i == 0 or self.ends[i - 1] <= a

    def add(self, a: int, b: int) -> None:
        i = bisect_right(self.starts, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)

    def near(self, a: int, b: int, reach: int) -> bool:
        """Whether one is within ``reach`` characters of [a, b)."""
        return not self.free(a - reach, b + reach)


@lru_cache(maxsize=1 << 16)
def folds(term: str) -> tuple[str, ...]:
    """The forms of a word in mail addresses: accents cut from letters, or such letters left out."""
    low = term.lower().replace("'", "").replace("-", "")
    plain = unicodedata.normalize("NFKD", low)
    bare = "".join(c for c in plain if not unicodedata.combining(c)).replace("ø", "o").replace("ß", "ss").replace("ł", "l")
    gone = "".join(c for c in unicodedata.normalize("NFC", low) if c.isascii())
    return tuple({bare, gone})


def mail_words(local: str) -> set[str]:
    """Words that a mail address's local part may be made of, before any ``+`` tag."""
    out = set(_PARTS.findall(local.split("+")[0].lower()))
    # an initial before a surname
    return out | {w[1:] for w in out if len(w) > 4}


Span = tuple[str, int, int]


def pattern_spans(text: str) -> list[Span]:
    """(kind, start, end) of what patterns tell alone; spans don't overlap.  ``text`` is flat."""
    out: list[Span] = []
    taken = Places()
    free = taken.free

    def take(kind: str, a: int, b: int) -> None:
        out.append((kind, a, b))
        taken.add(a, b)

    done = 0
    low = _lower(text)
    for sign in MAIL_SIGN.finditer(text) if any(h in low for h in MAIL_HINTS) else ():
        at = sign.start()
        while at > done and sign.start() - at < 3 and text[at - 1] in " [({<":
            at -= 1
        m = EMAIL.match(text, max(done, _LOCAL_BACK.match(text, 0, at).start()))
        if m is None or not m.end(1) <= sign.start() < m.start(2):
            continue
        done = m.end()
        if _NOT_MAIL.match(m[3]):
            continue
        if m[1].lower() in ("git", "hg", "svn") and text[m.end() : m.end() + 1] in (":", "/"):
            continue
        if text[m.end() : m.end() + 1] == ":" and regex.match(r":[\w~.-]+/", text[m.end() :][:80]):
            continue
        take("email", m.start(), m.end())
    for at in sorted({end - n + 1 for end, n in _stems().iter(low)}):
        m = ID_NUMBER.match(text, at)
        if m and any(c.isdigit() for c in m[1]) and free(m.start(1), m.end(1)):
            take("identity_number", m.start(1), m.end(1))
    bare = [(m.start() - 3, m.end()) for m in _SSN_TAIL.finditer(text) if m.start() >= 3 and text[m.start() - 3 : m.start()].isdecimal()]
    for a, b in sorted(bare + [m.span() for m in _NINO.finditer(text)]):
        if _FREE_BEFORE.match(text, a) and free(a, b):
            take("identity_number", a, b)
    for m in PHONE.finditer(text):
        digits = sum(c.isdigit() for c in m[0])
        if not 9 <= digits <= 15 or not free(m.start(), m.end()):
            continue
        label = _ASSIGNED.search(text, max(0, m.start() - 40), m.start())
        if label and not _PHONE_LABEL.search(label[1]):
            continue
        take("phone", m.start(), m.end())
    for m in ADDRESS.finditer(text):
        if free(m.start(), m.end()):
            take("street_address", m.start(), m.end())
    return out


Candidate = tuple[str, int, int, str, str]


def name_candidates(text: str, spans: list[Span]) -> list[Candidate]:
    """(shape, start, end, given, surname) of what may be a person's name; terms in lower case.

    Shapes: full (given before surname), short (initial and surname), turned (surname, given) and
    titled (a title and a surname; the title, in lower case, as its given name).  Candidates
    overlap each other, but not ``spans``.
    """
    free = Places((a, b) for _, a, b in spans).free
    out: list[Candidate] = []
    for m in FULL.finditer(text, overlapped=True):
        if free(m.start(), m.end()):
            out.append(("full", m.start(), m.end(), m[1].lower(), m[3].lower()))
    for m in SHORT.finditer(text, overlapped=True):
        if free(m.start(), m.end()):
            out.append(("short", m.start(), m.end(), "", m[2].lower()))
    for m in TURNED.finditer(text, overlapped=True):
        if free(m.start(), m.end()):
            # "von" behind a German participle is no part of the name
            own = _BEFORE.search(text, max(0, m.start() - 12), m.start())
            a = own.start() if own and free(own.start(), m.end()) and not _BY.search(text, max(0, own.start() - 24), own.start()) else m.start()
            out.append(("turned", a, m.end(), "" if "." in m[2] else m[2].lower(), m[1].lower()))
    for m in TITLED.finditer(text, overlapped=True):
        if free(m.start(), m.end()):
            out.append(("titled", m.start(2) if not m[1] else m.start(1), m.end(), regex.split(r"[.\s]", m[0], maxsplit=1)[0].lower(), m[2].lower()))
    return out
