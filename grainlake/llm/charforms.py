"""One form for text that looks the same: the confusables skeleton and the word fold built on it.

skeleton: decompose canonically, replace each character by its prototype, decompose again.
canonical: the skeleton composed again, the one form in which texts are given out and compared.
fold: canonical text in lower case ASCII without accents, words separated by single blanks.
"""

from __future__ import annotations

import re
import unicodedata

# Letters of other alphabets (and Latin variants) with the shape of a Latin letter, and that letter.
CYRILLIC = "АВЕЅІЈКМНОРСТУХаеорсухѕіјһԁԛԝҮүᴦӏ"
CYRILLIC_AS = "ABESIJKMHOPCTYXaeopcyxsijhdqwYyrl"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϺονϲϳ"
GREEK_AS = "ABEZHIKMNOPTYXCMovcj"
ARMENIAN = "ՕՍօսհո"
ARMENIAN_AS = "OUouhn"
LATIN = "ÐƉɑɡɩı"
LATIN_AS = "ĐĐagii"
LISU = "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ"
LISU_AS = "BPDTGKJCZFMNLSRVHWXYAEIOU"
CHEROKEE = "ᎪᎠᎡᎢᎫᎬᎳᎷᎻᎽᏀᏃᏙᏚᏞᏟᏢᏦ"
CHEROKEE_AS = "ADRTJEWMHYGZVSLCPK"

_INVISIBLE_MARKS = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10)]


def _prototypes() -> dict[int, str | None]:
    """Character to prototype; None drops it. Widths, spaces and invisible characters follow from Unicode's own data.

    Only the basic plane: the few invisible characters beyond it form flags of emoji and stay.
    """
    table: dict[int, str | None] = {}
    for code in range(0x10000):
        kind = unicodedata.category(chr(code))
        if kind == "Zs" and code != 0x20:
            table[code] = " "
        elif kind == "Cf":
            table[code] = None
        elif 0xFF00 < code < 0xFFEF:
            way, _, target = unicodedata.decomposition(chr(code)).partition(" ")
            if way in ("<wide>", "<narrow>"):
                table[code] = "".join(chr(int(x, 16)) for x in target.split())
        elif 0x2160 <= code <= 0x217F or 0xFB00 <= code <= 0xFB06:  # numerals and ligatures that are drawn as their letters
            table[code] = unicodedata.normalize("NFKC", chr(code))
    table |= dict.fromkeys(_INVISIBLE_MARKS)
    for odd, plain in ((CYRILLIC, CYRILLIC_AS), (GREEK, GREEK_AS), (ARMENIAN, ARMENIAN_AS), (LATIN, LATIN_AS), (LISU, LISU_AS), (CHEROKEE, CHEROKEE_AS)):
        table |= {ord(a): b for a, b in zip(odd, plain, strict=True)}
    table |= {0x2028: "\n", 0x2029: "\n", 0x85: "\n"}
    return table


PROTOTYPE = _prototypes()


def _char_class(codes: list[int]) -> str:
    """A regular expression class of sorted code points, as ranges."""
    spans: list[list[int]] = []
    for c in sorted(codes):
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "[" + "".join(rf"\u{a:04x}-\u{b:04x}" for a, b in spans) + "]"


def _composed() -> list[int]:
    """Characters that aren't odd themselves but hold an odd one when they are decomposed, like a Greek letter with an accent."""
    found = []
    for code in range(0x80, 0x10000):
        if code not in PROTOTYPE and not 0xD800 <= code < 0xE000 and any(ord(c) in PROTOTYPE for c in unicodedata.normalize("NFD", chr(code))):
            found.append(code)
    return found


_ODD = re.compile(_char_class([*PROTOTYPE, *_composed()]))
_ODD_RUN = re.compile(_char_class(list(PROTOTYPE)) + "+")
_PUNCT = re.compile("[^\x00-\x7fÀ-ɏ\u0300-\u036fḀ-ỿ]+")
_WORD_BYTES = bytes(c if chr(c).isalnum() and c < 128 else 0x20 for c in range(256))


def _replace(match: re.Match[str]) -> str:
    return match[0].translate(PROTOTYPE)


def skeleton(text: str) -> str:
    """Decomposed prototypes; two texts look the same if and only if their skeletons are equal."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    once = unicodedata.normalize("NFD", text)
    return unicodedata.normalize("NFD", _ODD_RUN.sub(_replace, once))


def canonical(text: str) -> str:
    """The composed skeleton. A text already composed, without odd characters, is returned as it is."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if not text.isascii() and _ODD.search(text):
        text = _ODD_RUN.sub(_replace, unicodedata.normalize("NFD", text))
    return unicodedata.normalize("NFC", text)  # decomposes again, then composes


def ascii_fold(text: str) -> bytes:
    """Lower case ASCII without accents, from the skeleton; other characters become blanks, lines stay."""
    if text.isascii():
        return text.lower().encode("ascii")
    if _ODD.search(text):
        text = _ODD_RUN.sub(_replace, unicodedata.normalize("NFD", text))
    text = unicodedata.normalize("NFD", text.lower())
    if "đ" in text:
        text = text.replace("đ", "d")
    if _PUNCT.search(text):
        text = _PUNCT.sub(" ", text.replace("²", "2").replace("³", "3"))
    return text.encode("ascii", "ignore")


def word_line(text: str) -> bytes:
    """The words of letters and digits after the fold, separated by single blanks."""
    return b" ".join(ascii_fold(text).translate(_WORD_BYTES).split())


def words(text: str) -> list[str]:
    """Words of letters and digits after the fold."""
    return ascii_fold(text).translate(_WORD_BYTES).decode("ascii").split()
