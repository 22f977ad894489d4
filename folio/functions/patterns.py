"""Patterns of personal data, written from public formats only: RFC 5322 (a subset), the North American numbering plan, SSA
number structure, ISO/IEC 7812 card lengths, RFC 3986, ISO 8601. No look-around and no word boundaries, so that any engine
reads them alike.
"""

_AREA = "(?:00[1-9]|0[1-9][0-9]|[1-57-8][0-9][0-9]|6[0-57-9][0-9]|66[0-57-9])"
_GROUP, _SERIAL = "(?:0[1-9]|[1-9][0-9])", "(?:000[1-9]|00[1-9][0-9]|0[1-9][0-9][0-9]|[1-9][0-9][0-9][0-9])"
#: A social security number as SSA issues them: no area 000, 666 or 900 on, no group 00, no serial 0000; dashes or spaces.
SSN = f"{_AREA}-{_GROUP}-{_SERIAL}|{_AREA} {_GROUP} {_SERIAL}"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
PHONE = r"\(?[2-9][0-9]{2}\)?[ .-][2-9][0-9]{2}[ .-][0-9]{4}"
#: Labels of masking, in the order of the counts.
LABELS = ["EMAIL", "SSN", "PHONE", "NUMBER", "CARD", "ROUTING", "ACCOUNT"]
#: Words before a run of digits that tell what it is, in lower case (fixed values); how many characters before it they may stand; a cue as second group.
CUES, REACH = {"SSN": ["ssn", "social security"], "ROUTING": ["routing", "aba"], "ACCOUNT": ["account", "acct", "iban"]}, 40
CUE = f"(^|[^a-z])({'|'.join(word for words in CUES.values() for word in words)})"
#: What stands before and after an item that may not touch digits, without look-around.
BEFORE, AFTER = "(^|[^0-9])", "($|[^0-9])"


def numbers(n: int = 1) -> str:
    """Candidates of masking made of digits, in a text whose other characters stand n times each: cards in groups, social security numbers, phones, and runs of six digits or more."""
    cards = [(n * s).join(f"[0-9]{{{w}}}" for w in widths) for widths in CARDS if len(widths) > 1 for s in " -"]
    ssn = [(n * s).join((_AREA, _GROUP, _SERIAL)) for s in "- "]
    gap = f"(?:{'|'.join(n * s for s in (' ', '[.]', '-'))})"
    phone = f"(?:(?:{n * '[+]'})?1{gap})?(?:{n * '[(]'})?[2-9][0-9]{{2}}(?:{n * '[)]'})?{gap}[2-9][0-9]{{2}}{gap}[0-9]{{4}}"
    return "|".join([*cards, *ssn, phone, "[0-9]{6,}"])


ENTITIES = [
    ("email", EMAIL),
    ("phone", PHONE),
    ("url", r"https?://[A-Za-z0-9.-]+(?:/[A-Za-z0-9._~/?#%&=+-]*)?"),
    ("date", r"[12][0-9]{3}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])"),
    ("money", r"\$[0-9]+(?:,[0-9]{3})*(?:\.[0-9]{2})?"),
]
NUMBER_TOKEN = r"[0-9][0-9,.]*[0-9]"
#: How many digits stand together in what may be a card number (ISO/IEC 7812; in a row, by fours, or 4-6-5), a social security number, a date (fixed values).
CARDS, SSNS, DATES = [(n,) for n in range(13, 20)] + [(4, 4, 4, 4), (4, 6, 5)], [(3, 2, 4)], [(4, 2, 2)]


def shapes(widths: list[tuple[int, ...]], separators: str) -> str:
    """Groups of so many digits joined by one of the separators and touching no other digit, in a text whose other characters stand twice, so that neighbours share none; group 2 is the item."""
    each = list(dict.fromkeys((2 * s).join(f"[0-9]{{{n}}}" for n in w) for w in widths for s in separators))
    return f"{BEFORE}({'|'.join(each)}){AFTER}"
