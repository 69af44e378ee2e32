"""The detector families and how their patterns run on the JVM.

``FAMILIES`` is the contract: which text counts as sensitive, in which order the
families are tried and which raw matches cancel a match of another family. The
patterns are written in ECMAScript syntax because that is the dialect whose
results they must reproduce; :func:`to_java` restates one for ``java.util.regex``
and :func:`to_re2` for RE2 (DuckDB).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Categories, detector toggles and patterns of the masking contract.
# ---------------------------------------------------------------------------

CATEGORIES = (
    "PERSON", "COMPANY", "EMAIL", "PHONE", "ADDRESS",
    "PRICE", "IBAN", "CARD", "SALARY",
    "SSN", "NIR", "SIRET", "VAT", "GOV_ID", "PASSPORT", "LICENSE",
    "URL", "HANDLE", "IP", "MAC", "API_KEY", "PASSWORD",
    "DATE", "INTERNAL_CODE", "PROJECT", "CLIENT", "ID", "CUSTOM",
)

DETECTORS = (
    "email", "phone", "person", "organization", "address",
    "price", "iban", "creditCard", "salary",
    "governmentId", "passport", "driverLicense",
    "url", "socialHandle", "ipAddress", "macAddress",
    "apiKey", "password",
    "date", "internalCode",
)

_MONTHS_FR = (
    "(?:janvier|f[ée]vrier|fevrier|mars|avril|mai|juin|juillet|ao[ûu]t|aout|"
    "septembre|octobre|novembre|d[ée]cembre|decembre)"
)
_MONTHS_EN = (
    "(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|"
    "Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
)
_DATE_EN = _MONTHS_EN + r"\.?\s+\d{1,2}(?:st|nd|rd|th)?,?\s+\d{2,4}"
_ID_QUALIFIER = (
    r"(?:\s+(?:britannique|am[eé]ricain(?:e)?|fran[çc]ais(?:e)?|allemand(?:e)?|italien(?:ne)?|"
    r"espagnol(?:e)?|europ[eé]en(?:ne)?|canadien(?:ne)?|US|UK|FR|DE|IT|ES|EU|CA|number|"
    r"num[eé]ro|n[°ºo]\.?|de\s+conduire|est\s+le|est\s+la|est|le|la))*"
)
_AMOUNT = r"(?:\d{1,3}(?:[ .,]\d{3})+|\d+)(?:[.,]\d{2})?"

PATTERNS = {
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "salary": (
        r"\b(?:gagne|touche|per[çc]oit|earns?|makes?|paid)\s+(?:[^\n.,;]*?)"
        r"(?:\d[\d\s.,]*\s*(?:€|EUR|USD|CAD|GBP|CHF|\$|£)|\$\s?\d+[kKmM]?|\d+[kKmM]\b)"
        r"(?:\s+(?:par\s+an|annually|per\s+year|\/an|\/year))?"
    ),
    "birth_date": (
        r"\b(?:born|n[ée]e?\s+le)\s+(?:\d{1,2}\s+" + _MONTHS_FR + r"\s+\d{2,4}|" + _DATE_EN + r")\b"
    ),
    "address_fr": (
        r"\b\d{1,4}\s+(?:(?:bis|ter)\s+)?(?:rue|avenue|av\.|boulevard|bd|chemin|impasse|place|"
        r"all[ée]e|route)\s+[^\n,]+,\s*\d{5}\s+[A-Za-zÀ-ÖØ-öø-ÿ' -]+\b"
    ),
    "address_en": (
        r"\b\d{1,5}[A-Z]?\s+(?:[A-Z][a-zA-Z]+\s+){1,4}(?:Avenue|Ave|Street|St|Boulevard|Blvd|Road|"
        r"Rd|Drive|Dr|Lane|Ln|Way|Plaza|Place|Pl|Court|Ct|Square|Sq|Highway|Hwy)\.?,\s*"
        r"[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+){0,3}(?:,\s*[A-Z]{2}(?:\s+\d{5}(?:-\d{4})?)?)?\b"
    ),
    "zip_us": r"\bZIP(?:code)?\s+\d{5}(?:-\d{4})?\b",
    "rib": (
        r"\bBanque\s*:\s*\d{5}\s*,\s*Guichet\s*:\s*\d{5}\s*,\s*Compte\s*:\s*\d{8,11}\s*,"
        r"\s*Cl[eé]\s*:\s*\d{2}\b"
    ),
    "iban": r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]){11,30}\b",
    "card": (
        r"\b(?:4\d{3}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}|5[1-5]\d{2}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}|"
        r"6(?:011|5\d{2}|22\d)[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5}|"
        r"(?:\d{4}[ -]){3}\d{4})\b"
    ),
    "cvv": r"\b(?:CVV|CVC|CV2|CCV)\s*:?\s*\d{3,4}\b",
    "expiry": r"\b(?:exp(?:iry|ires?)?|expiration)\s*:?\s*(?:0[1-9]|1[0-2])[/-](?:\d{2}|\d{4})\b",
    "bic": r"\b[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b",
    "nir": r"\b[12]\s\d{2}\s(?:0[1-9]|1[0-2])\s(?:\d{2}|2[AB])\s\d{3}\s\d{3}\s\d{2}\b",
    "siret": r"\b\d{3}\s\d{3}\s\d{3}\s\d{5}\b",
    "siren": r"\b\d{3}[\s-]\d{3}[\s-]\d{3}\b",
    "vat": (
        r"\b(?:AT|BE|BG|HR|CY|CZ|DK|EE|FI|FR|DE|GR|HU|IE|IT|LV|LT|LU|MT|NL|PL|PT|RO|SK|SI|ES|SE|GB)"
        r"\s?\d{2,3}\s?\d{6,12}\b"
    ),
    "ssn_us": r"\b\d{3}-\d{2}-\d{4}\b",
    "passport": (
        r"\b(?:passport|passeport)" + _ID_QUALIFIER +
        r"\s*:?\s*(?=[A-Z0-9-]*\d)[A-Z0-9](?:[A-Z0-9-]{4,18}[A-Z0-9])?\b"
    ),
    "driver_licence": (
        r"\b(?:permis|driver'?s?\s+licen[cs]e|DL)" + _ID_QUALIFIER +
        r"\s*:?\s*(?=[A-Z0-9-]*\d)[A-Z0-9](?:[A-Z0-9-]{4,20}[A-Z0-9])?\b"
    ),
    "ipv4": r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d{1,2})\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d{1,2})\b",
    "ipv6": r"\b(?:[A-Fa-f0-9]{1,4}:){7}[A-Fa-f0-9]{1,4}\b",
    "mac": r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b",
    "url": r"https?:\/\/[^\s)]+",
    "handle": r"@[a-zA-Z0-9._-]{2,}",
    "date_dmy": r"\b\d{1,2}\/\d{1,2}\/\d{2,4}\b",
    "date_fr_long": r"\b\d{1,2}(?:er|e|ème)?\s+" + _MONTHS_FR + r"\s+\d{2,4}\b",
    "date_iso": r"\b\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])\b",
    "date_en": r"\b" + _DATE_EN + r"\b",
    "api_key": (
        r"\b(?:sk-ant-(?:api\d+-)?[A-Za-z0-9_-]{20,}|sk-(?:proj-)?[A-Za-z0-9_-]{20,}|"
        r"xox[baprs]-[A-Za-z0-9-]{10,}|gh[opsu]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{20,}|"
        r"AKIA[A-Z0-9]{16}|ASIA[A-Z0-9]{16}|(?:sk|pk|rk)_(?:test|live)_[A-Za-z0-9]{20,}|"
        r"AIza[A-Za-z0-9_-]{30,})\b"
    ),
    "jwt": r"\beyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b",
    "bearer": r"\bBearer\s+[A-Za-z0-9_.\-+/=]{8,}\b",
    "password_line": r"\b(?:password|passwd|pwd|mot\s+de\s+passe|mdp)\s*[:=]\s*\S+",
    "phone": (
        r"(?:\+33\s?|0)[1-9](?:[\s.-]?\d{2}){4}|"
        r"\+\d{1,3}[\s.()-]{0,4}\d{1,4}(?:[\s.()-]{0,4}\d{1,4}){2,4}"
    ),
    "price": (
        r"\b(?:EUR|USD|CAD|GBP|CHF)\s?" + _AMOUNT + r"(?!\w)|"
        r"(?:€|\$|£)\s?" + _AMOUNT + r"(?!\w)|" +
        _AMOUNT + r"\s?(?:€|\$|£|EUR|USD|CAD|GBP|CHF)(?!\w)|"
        r"\$\s?\d+(?:\.\d+)?[kKmMbB](?!\w)"
    ),
    "code": (
        r"\b(?:(?=[A-Z0-9-_]{6,})(?=[A-Z0-9-_]*[0-9])[A-Z][A-Z0-9]*[-_][A-Z0-9]+(?:[-_][A-Z0-9]+)*|"
        r"(?=[A-Z]*[0-9])(?=[0-9]*[A-Z])[A-Z0-9]{%(id_min_length)d,})\b"
    ),
}

DEFAULT_ID_MIN_LENGTH = 10

# ---------------------------------------------------------------------------
# End of the fixed values. What follows is how Spark evaluates them.
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Family:
    """One detector family; its place in :data:`FAMILIES` is its tie-break rank."""

    name: str
    detector: str
    category: str
    ignore_case: bool = False
    #: families whose raw matches cancel an overlapping match of this one
    cancelled_by: tuple[str, ...] = ()
    #: the last character of a match may be a non-word character
    open_tail: bool = False
    #: cheap conditions of any match, tested before the pattern: one of these texts
    #: (in lower case under ``ignore_case``) and at least one digit, or nine digits
    #: with at most one character between neighbours, or one of ``or_any_of`` instead of nine
    #: digits; and so many colons (or colons and hyphens, if ``hyphens`` separate as well)
    any_of: tuple[str, ...] = ()
    digits: str = "some"
    or_any_of: tuple[str, ...] = ()
    colons: int = 0
    hyphens: bool = False
    #: a simple pattern that stands in every match, tested before a long list of texts
    shape: str | None = None


FAMILIES = (
    Family("email", "email", "EMAIL", any_of=("@",), digits="none"),
    Family("salary", "salary", "SALARY", ignore_case=True,
           any_of=("gagne", "touche", "perçoit", "percoit", "earn", "make", "paid")),
    Family("birth_date", "date", "DATE", ignore_case=True, any_of=("born", "le")),
    Family("address_fr", "address", "ADDRESS", ignore_case=True, open_tail=True,
           shape=r",\s*\d{5}", any_of=("rue", "avenue", "av.", "boulevard", "bd", "chemin", "impasse", "place", "allée",
                   "allee", "route")),
    Family("address_en", "address", "ADDRESS",
           shape=r",\s*[A-Z]", any_of=("Ave", "St", "Boulevard", "Blvd", "Road", "Rd", "Dr", "Lane", "Ln", "Way", "Pl", "Court", "Ct",
                   "Sq", "Highway", "Hwy")),
    Family("zip_us", "address", "ADDRESS", ignore_case=True, cancelled_by=("address_en",), any_of=("zip",)),
    Family("rib", "iban", "IBAN", ignore_case=True, any_of=("banque",)),
    Family("iban", "iban", "IBAN"),
    Family("card", "creditCard", "CARD", digits="nine"),
    Family("cvv", "creditCard", "CARD", ignore_case=True, any_of=("cv",)),
    Family("expiry", "creditCard", "CARD", ignore_case=True, any_of=("exp",)),
    Family("bic", "iban", "IBAN", cancelled_by=("vat",), digits="none"),
    Family("nir", "governmentId", "NIR"),
    Family("siret", "governmentId", "SIRET", digits="nine"),
    Family("siren", "governmentId", "GOV_ID", cancelled_by=("siret",), digits="nine"),
    Family("vat", "governmentId", "VAT", ignore_case=True),
    Family("ssn_us", "governmentId", "SSN", any_of=("-",), digits="nine"),
    Family("passport", "passport", "PASSPORT", ignore_case=True, any_of=("pass",)),
    Family("driver_licence", "driverLicense", "LICENSE", ignore_case=True,
           any_of=("permis", "driver", "dl")),
    Family("ipv4", "ipAddress", "IP", cancelled_by=("phone",), any_of=(".",)),
    Family("ipv6", "ipAddress", "IP", digits="none", any_of=(":",), colons=7),
    Family("mac", "macAddress", "MAC", digits="none", any_of=(":", "-"), colons=5, hyphens=True),
    Family("url", "url", "URL", any_of=("://",), digits="none"),
    Family("handle", "socialHandle", "HANDLE", cancelled_by=("email",), any_of=("@",), digits="none"),
    Family("date_dmy", "date", "DATE", cancelled_by=("expiry",), any_of=("/",)),
    Family("date_fr_long", "date", "DATE", ignore_case=True, cancelled_by=("birth_date",),
           shape=r"\d[a-zA-ZèÈ]{0,3}\s+[jfmasondJFMASOND]", any_of=("janvier", "vrier", "mars", "avril", "mai", "juin", "juillet", "ao", "septembre",
                   "octobre", "novembre", "cembre")),
    Family("date_iso", "date", "DATE", any_of=("-",)),
    Family("date_en", "date", "DATE", ignore_case=True, cancelled_by=("birth_date",),
           shape=r"\s\d{1,2}[a-zA-Z]{0,2},?\s+\d{2}", any_of=("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")),
    Family("api_key", "apiKey", "API_KEY", open_tail=True, digits="none",
           any_of=("sk", "xox", "gh", "AKIA", "ASIA", "pk_", "rk_", "AIza")),
    Family("jwt", "apiKey", "API_KEY", open_tail=True, any_of=("eyJ",), digits="none"),
    Family("bearer", "apiKey", "API_KEY", open_tail=True, any_of=("Bearer",), digits="none"),
    Family("password_line", "password", "PASSWORD", ignore_case=True, digits="none",
           any_of=("pass", "pwd", "mot", "mdp")),
    Family("phone", "phone", "PHONE", cancelled_by=("iban", "url", "price"), any_of=("+", "0"),
           digits="nine", or_any_of=("+",)),
    Family("price", "price", "PRICE", cancelled_by=("email", "iban", "url", "salary"),
           any_of=("€", "$", "£", "EUR", "USD", "CAD", "GBP", "CHF")),
    Family("code", "internalCode", "ID", ignore_case=True, cancelled_by=("url", "price")),
)
SEQ = {f.name: i + 1 for i, f in enumerate(FAMILIES)}

#: ECMAScript ``\s``: Java and RE2 only know the ASCII part of it.
_SPACES = r"\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_SPACES_RE2 = (
    r"\t-\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
)
_HEAD = r"(?<!\w)"
_TAIL = r"(?!\w)"
FULL_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def _tokens(pattern: str):
    """Yield ``(token, in_class)``; an escape pair or ``\\uXXXX`` is one token."""
    i, in_class = 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            width = 6 if pattern[i + 1] == "u" else 2
            yield pattern[i:i + width], in_class
            i += width
            continue
        if c == "[" and not in_class:
            in_class = True
            yield c, False
        elif c == "]" and in_class:
            in_class = False
            yield c, False
        else:
            yield c, in_class
        i += 1


def _other_case(c: str) -> str:
    """The other-case form of a non-ASCII letter, if it is one non-ASCII character."""
    other = c.upper() if c.upper() != c else c.lower()
    return other if len(other) == 1 and other != c and ord(other) >= 128 else ""


def _class_partners(body: list[str]) -> str:
    """Case partners missing from a character class that has non-ASCII members."""
    members: list[str] = []
    i = 0
    while i < len(body):
        if i + 2 < len(body) and body[i + 1] == "-" and ord(body[i][-1]) >= 128:
            members += [chr(n) for n in range(ord(body[i]), ord(body[i + 2]) + 1)]
            i += 3
        else:
            if len(body[i]) == 1 and ord(body[i]) >= 128:
                members.append(body[i])
            i += 1
    partners = {_other_case(c) for c in members} - set(members) - {""}
    return "".join(sorted(partners))


def to_java(pattern: str, ignore_case: bool = False, open_tail: bool = False) -> str:
    r"""Restate an ECMAScript pattern for ``java.util.regex``.

    * ``\b`` is ASCII in ECMAScript and Unicode-aware in Java. Next to a character
      that must be a word character one negative look-around is enough, and it is
      the cheap form: ``(?<!\w)`` before it, ``(?!\w)`` after it. ``open_tail``
      keeps the two-sided form where a match may end in a non-word character.
    * ``\s`` covers the Unicode spaces, also inside classes and negated.
    * Under ``ignore_case`` ASCII letters fold with ``(?i)`` and every non-ASCII
      letter is spelled in both cases. ``(?iu)`` would also fold across the ASCII
      border (long s, Kelvin sign), which ECMAScript does not.
    """
    out: list[str] = []
    body: list[str] = []
    prev = ""
    for tok, in_class in _tokens(pattern):
        if tok == "[" and not in_class:
            body = []
        elif in_class:
            body.append(tok)
        elif tok == "]":
            negated = ["^"] if body[:1] == ["^"] else []
            members = body[len(negated):]
            partners = _class_partners(members) if ignore_case else ""
            spelled = "".join({r"\s": _SPACES, "[": r"\["}.get(t, t) for t in members)
            out.append("[" + "".join(negated) + partners + spelled + "]")
        elif tok == r"\b":
            head = prev in ("", "|", "(", ":")
            out.append(_HEAD if head else FULL_BOUNDARY if open_tail else _TAIL)
        elif tok == r"\s":
            out.append(f"[{_SPACES}]")
        elif tok == r"\S":
            out.append(f"[^{_SPACES}]")
        elif ignore_case and len(tok) == 1 and ord(tok) >= 128 and _other_case(tok):
            out.append(f"[{tok}{_other_case(tok)}]")
        else:
            out.append(tok)
        prev = tok
    return ("(?i)" if ignore_case else "") + "".join(out)


def to_re2(pattern: str, ignore_case: bool = False) -> str:
    r"""Restate an ECMAScript pattern for RE2; ``\b`` is ASCII there already."""
    out = []
    for tok, in_class in _tokens(pattern):
        if tok == r"\s":
            out.append(_SPACES_RE2 if in_class else f"[{_SPACES_RE2}]")
        elif tok == r"\S":
            out.append(f"[^{_SPACES_RE2}]")
        else:
            out.append(tok)
    return ("(?i)" if ignore_case else "") + "".join(out)


# Some patterns take quadratic time on one long run of characters (a base64 blob, a
# page of digits) or recurse once per group repetition, which overflows the stack of
# an executor thread. Their JVM forms below find the same matches in linear time
# without recursion; tests compare both forms on random text.
#  email   a run of local-part characters either leads to '@' at its end or nowhere,
#          so only its first character (or the end of the previous match) can start.
#  salary  the blanks before the currency are members of the class in front of them.
#  price   a digit run that fails from its first digit fails from the later ones.
#  mac     the boundary is tested behind the first pair, where few positions are left;
#  ipv6    the first group stands alone, so that its first character comes first;
#  phone, vat  begin with a test of characters that most positions fail.
#  code    pieces are taken possessively; a piece followed by '_' cannot end a match.
#          Both alternatives need a digit in the run, which is looked for only once.
_AMOUNT_ONCE = r"(?:\d{1,3}(?:[ .,]\d{3})+|(?<!\d)\d++)(?:[.,]\d{2})?"
_PIECE = r"[A-Z0-9]++(?:_[A-Z0-9]++)*+(?!_)"
_REWRITES = {
    "email": [("[a-zA-Z0-9._%+-]+@", r"(?:\G|(?<![a-zA-Z0-9._%+-]))[a-zA-Z0-9._%+-]++@")],
    "salary": [(r"[\d\s.,]*\s*(?:", r"[\d\s.,]*+(?:")],
    "price": [("|" + _AMOUNT + r"\s?(?:€", "|" + _AMOUNT_ONCE + r"\s?(?:€")],
    "mac": [(r"\b(?:[0-9A-Fa-f]{2}[:-]){5}", (
        r"[0-9A-Fa-f]{2}[:-](?<!\w[0-9A-Fa-f]{2}[:-])(?:[0-9A-Fa-f]{2}[:-]){4}"))],
    "ipv6": [(r"\b(?:[A-Fa-f0-9]{1,4}:){7}", r"\b[A-Fa-f0-9]{1,4}:(?:[A-Fa-f0-9]{1,4}:){6}")],
    "phone": [(r"(?:\+33\s?|0)", r"(?=[+0])(?:(?:\+33\s?|0)"), (r"{2,4}", r"{2,4})")],
    "vat": [(r"\b(?:AT|", r"(?=[A-Z]{2}\s?\d)(?<!\w)(?:AT|")],
    "code": [(r"\b(?:(?=[A-Z0-9-_]{6,})", r"\b(?=[A-Z_-]*+[0-9])(?:(?=[A-Z0-9-_]{6,})"), (
        r"[A-Z][A-Z0-9]*[-_][A-Z0-9]+(?:[-_][A-Z0-9]+)*|",
        r"[A-Z][A-Z0-9]*+(?:(?:_[A-Z0-9]++)++(?!_)(?:-" + _PIECE + r")*+|(?:-" + _PIECE + r")++)|",
    )],
}


def ecma_pattern(family: Family, id_min_length: int = DEFAULT_ID_MIN_LENGTH) -> str:
    pattern = PATTERNS[family.name]
    return pattern % {"id_min_length": id_min_length} if family.name == "code" else pattern


def _first_character_first(java: str) -> str:
    """Test the first character before the boundary in front of it: ``(?<!\\w)A{n,m}``
    becomes ``A(?<!\\wA)A{n-1,m-1}``. The look-behind is the dear part at positions
    where the pattern cannot start anyway."""
    head = re.match(r"(\(\?i\))?\(\?<!\\w\)(\\d|\[[^\]]+\])(?:\{(\d+)(?:,(\d+))?\})?(?![*+?{])", java)
    if not head:
        return java
    flag, atom, low, high = head.group(1) or "", head.group(2), head.group(3), head.group(4)
    more = ""
    if low:
        bounds = str(int(low) - 1) + (f",{int(high) - 1}" if high else "")
        more = "" if bounds == "0" else f"{atom}{{{bounds}}}"
    return f"{flag}{atom}(?<!\\w{atom}){more}{java[head.end():]}"


#: character classes and cheaper ones of the same characters: Java tests the members of a
#: class one after the other, and its own classes by one look-up
_CLASSES = [
    (f"[{_SPACES}]", r"[\s[\u0080-\uffff&&[" + _SPACES.removeprefix(r"\t-\r ") + "]]]"),
    ("[a-zA-Z0-9._%+-]", r"[\w.%+-]"), ("[a-zA-Z0-9._-]", r"[\w.-]"),
    ("[A-Za-z0-9_-]", r"[\w-]"), ("[a-zA-Z]", r"\p{Alpha}"),
    ("[0-9A-Fa-f]", r"\p{XDigit}"), ("[A-Fa-f0-9]", r"\p{XDigit}"), ("[0-9]", r"\d"),
]
_CLASSES_ANY_CASE = [
    ("[A-Z0-9-_]", r"[\w-]"), ("[A-Z_-]", r"[\p{Alpha}_-]"), ("[A-Z0-9-]", r"[\p{Alnum}-]"),
    ("[A-Z0-9]", r"\p{Alnum}"), ("[A-Z]", r"\p{Alpha}"),
]


def cheap_classes(java: str) -> str:
    for old, new in _CLASSES + (_CLASSES_ANY_CASE if java.startswith("(?i)") else []):
        java = java.replace(old, new)
    return java


def java_pattern(family: Family, id_min_length: int = DEFAULT_ID_MIN_LENGTH) -> str:
    pattern = ecma_pattern(family, id_min_length)
    for old, new in _REWRITES.get(family.name, ()):
        if old not in pattern:
            raise ValueError(f"{family.name}: pattern changed, rewrite no longer applies")
        pattern = pattern.replace(old, new)
    return cheap_classes(_first_character_first(to_java(pattern, family.ignore_case, family.open_tail)))


@dataclass(frozen=True)
class MaskConfig:
    """Which detectors run and how placeholders look; everything is on by default."""

    off: frozenset[str] = field(default_factory=frozenset)
    id_min_length: int = DEFAULT_ID_MIN_LENGTH
    placeholder_style: str = "brackets"

    def __post_init__(self):
        unknown = set(self.off) - set(DETECTORS)
        if unknown:
            raise ValueError(f"unknown detectors: {sorted(unknown)}")
        if self.placeholder_style not in ("brackets", "curly"):
            raise ValueError("placeholder_style must be 'brackets' or 'curly'")

    @classmethod
    def from_partial(cls, partial: dict | None = None) -> "MaskConfig":
        """Merge ``{"detectors": {...}, "idMinLength": n, "placeholderStyle": s}`` over the defaults."""
        partial = partial or {}
        toggles = partial.get("detectors") or {}
        default = cls()

        def given(key, fallback):
            value = partial.get(key)
            return fallback if value is None else value

        return cls(
            off=frozenset(k for k, on in toggles.items() if not on),
            id_min_length=given("idMinLength", default.id_min_length),
            placeholder_style=given("placeholderStyle", default.placeholder_style),
        )

    @classmethod
    def only(cls, *detectors: str, **kw) -> "MaskConfig":
        return cls(off=frozenset(DETECTORS) - set(detectors), **kw)

    def without(self, *detectors: str) -> "MaskConfig":
        return MaskConfig(self.off | set(detectors), self.id_min_length, self.placeholder_style)

    def on(self, detector: str) -> bool:
        return detector not in self.off

    def families(self) -> list[Family]:
        return [f for f in FAMILIES if self.on(f.detector)]
