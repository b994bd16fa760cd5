"""The character encoding of bytes: byte order marks, then what the bytes can be, then what reads like a language.

Multibyte encodings are told by their own rules (a strict decoder fails where bytes break them) and by the characters they
give; single-byte ones, in which nearly all bytes are something, by the letters of the languages written in them.
"""

from __future__ import annotations

import codecs
import math
import re
import unicodedata
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

from .language import SAMPLES

#: Bytes from the start of a file that tell its encoding.
HEAD = 64 << 10
_MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
# Single-byte encodings and the languages written in them, by how common they are (fixed values).
SINGLE = {
    "windows-1252": "en de fr es it pt nl sv da no fi id", "windows-1251": "ru bg uk sr", "windows-1250": "pl cs hu ro", "windows-1253": "el", "windows-1254": "tr",
    "windows-1255": "he", "windows-1256": "ar fa", "koi8-r": "ru", "iso-8859-2": "pl cs hu ro", "iso-8859-5": "ru bg sr", "ibm866": "ru", "windows-874": "th",
}
# Letters outside ASCII of the languages written in Latin letters (fixed values).
LETTERS = {
    "cs": "áčďéěíňóřšťúůýž", "da": "åæø", "de": "äöüß", "en": "é", "es": "áéíñóúü", "fi": "äö", "fr": "àâçèéêëîïôùûüœ", "hu": "áéíóöőúüű", "id": "", "it": "àèéìòù", "nl": "éëïóö", "no": "åæø", "pl": "ąćęłńóśźż",
    "pt": "àáâãçéêíóôõú", "ro": "âîășțşţ", "sv": "äåö", "tr": "çöüğış",
}
# Multibyte encodings, the characters that text in them has, and frequent ones among these (fixed values).
MULTI = {
    "shift_jis": ("[぀-ヿ]", ""), "euc-jp": ("[぀-ヿ]", ""), "euc-kr": ("[가-힣]", ""),
    "gb18030": ("[一-鿿]", "的一是不了在人有我他这个们中来上大为和国地到以说时要就出会可也你对生能而子那得于着下自之年过发后作里"),
    "big5": ("[一-鿿]", "的一是不了在人有我他這個們中來上大為和國地到以說時要就出會可也你對生能而子那得於著下自之年過發後作裡"),
}
_CODECS = {"windows-874": "cp874", "ibm866": "cp866"}
_WIDE = re.compile("[　-ヿ一-鿿가-힣＀-￯]")


class Decoded(NamedTuple):
    """Text in composed form without marks, its encoding, and whether it had a mark or lost bytes."""

    text: str
    encoding: str
    had_mark: bool
    lossy: bool


@lru_cache
def _letter_weights(lang: str) -> dict[str, float]:
    """Logarithms of how often each letter outside ASCII stands in a language's sample and alphabet."""
    counts = Counter(c for c in SAMPLES[lang].lower() + 2 * LETTERS.get(lang, "") if ord(c) > 127 and unicodedata.category(c)[0] in "LM")
    total = sum(counts.values()) or 1
    return {c: math.log(n / total) for c, n in counts.items()}


#: Weights of letters that no sample has, of marks and signs, and of what no text has.
_RARE, _SIGN, _NEVER = -8.0, -6.0, -14.0
#: By how much another encoding must read better than the commonest, for each ten bytes outside ASCII.
LEAD = 2.0


#: What a second language in a text costs an encoding.
_SECOND = 4.0


def _single_score(head: bytes, encoding: str) -> float:
    """How well the bytes outside ASCII read in an encoding: letters as in the best one or two of its languages, in words
    that do not mix cases or scripts.  A word that is repeated tells nothing new and counts once."""
    out = head.decode(_CODECS.get(encoding, encoding), "replace")
    score, languages = 0.0, SINGLE[encoding].split()
    read = []  # for each word, how its letters read in each language
    for word in {w for w in re.findall(r"[^\x00-\x20]+", out) if not w.isascii()}:
        letters: Counter[str] = Counter()
        before = " "
        for c, after in zip(word, word[1:] + " "):
            if ord(c) > 127:
                beside = any(x.isalpha() and x.isascii() for x in (before, after))
                if c.isalpha() or unicodedata.category(c)[0] == "M":
                    letters[c.lower()] += 1
                    if c.isupper() and before.islower():
                        score += _NEVER / 2
                elif c == "\ufffd" or unicodedata.category(c) in ("Cc", "Cn", "Co"):
                    score += _NEVER
                else:
                    score += _SIGN + (_SIGN if before.isalpha() and after.isalpha() else 0)
                if beside and ord(c) > 0x24F and unicodedata.category(c)[0] in "LM":  # letters of other scripts in a Latin word
                    score += _NEVER
            before = c
        read.append([sum(n * _letter_weights(lang).get(c, _RARE) for c, n in letters.items()) for lang in languages])
    one = max(sum(r[k] for r in read) for k in range(len(languages)))
    two = [sum(max(r[k], r[j]) for r in read) - _SECOND for k in range(len(languages)) for j in range(k)]
    return score + max([one, *two])


def _multi_score(head: bytes, encoding: str) -> float | None:
    """The share of a strict reading's wide characters that text in the encoding has; none if the bytes break its rules."""
    decoder = codecs.getincrementaldecoder(encoding)()
    try:
        out = decoder.decode(head, final=len(head) < HEAD)
    except UnicodeDecodeError:
        return None
    wide = [c for c in out if ord(c) > 127]
    if not wide:
        return None
    kind, frequent = MULTI[encoding]
    right = sum(bool(re.match(kind, c)) for c in wide)
    known = sum(bool(_WIDE.match(c)) for c in wide)
    often = sum(c in frequent for c in wide) / max(right, 1) if frequent else 1.0
    share = right / len(wide)
    return share * min(1.0, 0.3 + 5 * often) if known / len(wide) > 0.9 else 0.0


def encoding_of(data: bytes) -> str:
    """The encoding of bytes without a mark: UTF-8 if they can be, else the reading that fits best."""
    head = data[:HEAD]
    try:
        codecs.getincrementaldecoder("utf-8")().decode(head, final=len(data) <= HEAD)
        return "iso-2022-jp" if b"\x1b$" in head and _multi_valid(head, "iso-2022-jp") else "utf-8"
    except UnicodeDecodeError:
        pass
    multi = {e: s for e in MULTI if (s := _multi_score(head, e)) is not None}
    best = max(multi, key=multi.get, default=None)
    if best is not None and multi[best] >= 0.35 and sum(b > 127 for b in head) >= 4:
        return best
    scores = {e: _single_score(head, e) for e in SINGLE}
    common, *_ = SINGLE
    best = max(scores, key=scores.get)
    alike = head.decode(_CODECS.get(best, best), "replace") == head.decode(common, "replace")
    return common if alike or scores[best] - scores[common] < LEAD * max(1, sum(b > 127 for b in head) / 10) else best


def _multi_valid(head: bytes, encoding: str) -> bool:
    try:
        head.decode(encoding)
    except UnicodeDecodeError:
        return False
    return True


def decode(data: bytes) -> Decoded:
    """Text of bytes in whatever encoding: never fails; what cannot be read is U+FFFD and makes it lossy."""
    for mark, encoding in _MARKS:
        if data.startswith(mark):
            out, marked = data[len(mark) :].decode(encoding, "replace"), True
            break
    else:
        encoding, marked = encoding_of(data), False
        out = data.decode(_CODECS.get(encoding, encoding), "replace")
    return Decoded(unicodedata.normalize("NFC", out.removeprefix("﻿")), encoding, marked, "�" in out)
