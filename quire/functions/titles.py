"""Title case of display titles.

A line is a row of words.  Each word goes to the first rule that knows its shape: what has a
form of its own keeps it, small words become lower, compound words are cased part by part,
and all others get a capital.  Afterwards the words that begin or end the line, and those that
begin a phrase in it, lose the small form.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from ..config import ROMAN, ROMAN_EXCLUDED, TITLE_CASE_EXCEPTIONS

# fixed values
SMALL = ("a", "an", "and", "as", "at", "but", "by", "en", "for", "if", "in", "of", "on", "or", "the", "to", "v", "v.", "via", "vs", "vs.")
PUNCTUATION = "!\"“#$%&'‘()*+,-–‒—―./:;?@[\\]_`{|}~"
PHRASE_ENDS = ":.;?!-–‒—―"

_SMALL = "|".join(re.escape(w) for w in sorted(SMALL, key=len, reverse=True))
_MARKS = f"[{re.escape(PUNCTUATION)}]"
_CORE = re.compile(r"^[^0-9A-Za-z]*(.*?)[^0-9A-Za-z]*$", re.S)
_ROMAN = re.compile(ROMAN, re.I)
_INITIALS = re.compile(r"(?:[A-Z]\.)+(?:[A-Z]\.?)*")
_ELIDED = re.compile(r"([dol])(['‘])([a-z])([a-z]*(?:'s|s'|''|ss)?)", re.I)
_MAC = re.compile(r"(mc|Mc|MC)(\w.+)", re.S)
_COURTESY = re.compile(r"(?:mr|mrs|ms|dr)", re.I)
_DOTTED = re.compile(r"\w\.\w")
_STYLED = re.compile(rf"{_MARKS}*[a-zA-Z]+[A-Z]")
_NO_VOWEL = re.compile(r"[bcdfghjklmnpqrstvwxz]{3,}", re.I)
_FIRST_LETTER = re.compile(rf"{_MARKS}*?\w")
_SMALL_FIRST = re.compile(rf"({_MARKS}*)({_SMALL})\b", re.I)
_SMALL_LAST = re.compile(rf"\b({_SMALL}){_MARKS}?$", re.I)
_SUBPHRASE = re.compile(rf"([{re.escape(PHRASE_ENDS)}] )({_SMALL})\b", re.I)
_ONE_SMALL = re.compile(_SMALL, re.I)

Rule = Callable[[str, bool, dict[str, str]], str | None]


def core(word: str) -> str:
    """The word without marks around it."""
    return _CORE.match(word)[1]


def kept(word: str, exceptions: dict[str, str]) -> str | None:
    """An exception in its own form, or a Roman numeral in capitals; None for other words."""
    own = core(word)
    if own.upper() in exceptions:
        return word.replace(own, exceptions[own.upper()])
    if len(own) > 1 and _ROMAN.fullmatch(own) and own.lower() not in ROMAN_EXCLUDED:
        return word.replace(own, own.upper())
    return None


def _initials(word: str, shouted: bool, exceptions: dict[str, str]) -> str | None:
    return word if shouted and _INITIALS.fullmatch(word) else None


def _elided(word: str, shouted: bool, exceptions: dict[str, str]) -> str | None:
    """d'Artagnan, l'Orangerie, but O'Reilly."""
    if not (m := _ELIDED.fullmatch(word)):
        return None
    head = m[1].upper() if m[1] in "oO" else m[1].lower()
    return head + m[2] + m[3].upper() + m[4]


def _mac(word: str, shouted: bool, exceptions: dict[str, str]) -> str | None:
    return m[1].capitalize() + titled(m[2], exceptions) if (m := _MAC.fullmatch(word)) else None


def _courtesy(word: str, shouted: bool, exceptions: dict[str, str]) -> str | None:
    return word[0].upper() + word[1:] if _COURTESY.fullmatch(word) else None


def _own_form(word: str, shouted: bool, exceptions: dict[str, str]) -> str | None:
    """Addresses and other words with an inner dot, and words with a capital inside."""
    return word if _DOTTED.search(word) or not shouted and _STYLED.match(word) else None


def _small(word: str, shouted: bool, exceptions: dict[str, str]) -> str | None:
    return word.lower() if _ONE_SMALL.fullmatch(word) else None


def _compound(word: str, shouted: bool, exceptions: dict[str, str]) -> str | None:
    mark = "/" if "/" in word and "//" not in word else "-"
    return mark.join(titled(part, exceptions, False) for part in word.split(mark)) if mark in word else None


def _plain(word: str, shouted: bool, exceptions: dict[str, str]) -> str:
    word = word.lower() if shouted else word
    if _NO_VOWEL.fullmatch(word):
        return word.upper()
    first = _FIRST_LETTER.match(word)
    return first[0].upper() + word[first.end() :] if first else word


RULES: tuple[Rule, ...] = (_initials, _elided, _mac, _courtesy, _small, _own_form, _compound, _plain)


def titled(text: str, exceptions: dict[str, str], whole: bool = True) -> str:
    """Title case of one line; ``whole`` gives its first and last words a capital, small or not."""
    shouted = text == text.upper()
    parts = re.split(r"([\t ])", text)
    fixed = set()
    for i in range(0, len(parts), 2):
        own = kept(parts[i], exceptions)
        if own is not None:
            fixed.add(i)
            parts[i] = own
        else:
            parts[i] = next(found for rule in RULES if (found := rule(parts[i], shouted, exceptions)) is not None)
    if whole:
        if 0 not in fixed and (m := _SMALL_FIRST.match(parts[0])):
            parts[0] = m[1] + m[2].capitalize() + parts[0][m.end() :]
        if len(parts) - 1 not in fixed:
            parts[-1] = _SMALL_LAST.sub(lambda m: m[0].capitalize(), parts[-1])
    return _SUBPHRASE.sub(lambda m: m[1] + m[2].capitalize(), "".join(parts))


def title_case_text(text: str, exceptions: Iterable[str] = TITLE_CASE_EXCEPTIONS) -> str:
    """Title case of a text, line by line; line ends become one line feed.  An empty text stays empty."""
    known = {e.upper(): e for e in exceptions if e}
    return "\n".join(titled(line, known) for line in re.split(r"[\r\n]+", text))
