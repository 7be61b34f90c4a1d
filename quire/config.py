"""Settings of normalisation and export; defaults are fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Substitution:
    find: str
    replace: str
    fields: tuple[str, ...]
    whole_word: bool = False


@dataclass(frozen=True)
class Normalisation:
    # fixed values
    honorific_tokens: tuple[str, ...] = ("RA", "PRA", "PPRA", "HON", "HONRA", "ELECT", "EX", "OFFICIO")
    edition_suppress_max: int = 0
    substitutions: tuple[Substitution, ...] = (Substitution("...", "…", ("title", "medium")),)


@dataclass(frozen=True)
class Money:
    symbol: str = "£"
    separator: str = ","
    edition_prefix: str = "edition of"
    brackets: bool = True


@dataclass(frozen=True)
class Component:
    """One part of an entry: its field and what follows it.

    ``max_line`` wraps it at so many characters; ``next_after_first_line`` then puts the next
    part behind its first line.  ``paragraph`` names the style of a paragraph it opens.
    """

    field: str
    separator: str = "tab"
    omit_when_empty: bool = True
    enabled: bool = True
    max_line: int | None = None
    next_after_first_line: bool = False
    balance: bool = False
    paragraph: str | None = None


# fixed values
COMPONENTS = (
    Component("work_number"), Component("artist"), Component("title"), Component("title_cased", enabled=False), Component("edition"),
    Component("artwork", enabled=False), Component("price", "none"), Component("medium", "none"),
)
STYLES = {
    "work_number": "CatNo", "artist": "ArtistName", "honorifics": "Honorifics", "title": "WorkTitle", "title_cased": "WorkTitle",
    "price": "Price", "medium": "Medium", "artwork": "Artwork", "edition": "Edition",
}


@dataclass(frozen=True)
class Layout:
    """Tagged text of a works list: styles, separators and the order of an entry's components."""

    # fixed values
    section_style: str = "SectionTitle"
    other_section_styles: tuple[str, ...] = ()
    entry_style: str = "CatalogueEntry"
    styles: dict[str, str] = field(default_factory=lambda: dict(STYLES))
    honorifics_lowercase: bool = False
    money: Money = field(default_factory=Money)
    section_separator: str = "paragraph"
    section_separator_style: str = ""
    leading: str = "none"
    trailing: str = "none"
    final_separator_from_last: bool = False
    components: tuple[Component, ...] = COMPONENTS


@dataclass(frozen=True)
class IndexLayout:
    """Tagged text of an artist index."""

    # fixed values
    entry_style: str = "Index Text"
    member_surname_style: str = "RA Member Cap Surname"
    member_quals_style: str = "RA Caps"
    quals_style: str = "Small caps"
    number_style: str = "Index works numbers"
    digits_style: str = "Expert numbers"
    quals_lowercase: bool = True
    style_digits: bool = False
    number_separator: str = ","
    number_separator_style: str = ""
    section_separator: str = "paragraph"
    section_separator_style: str = ""
    letter_headings: bool = False
    letter_heading_style: str = ""


@dataclass(frozen=True)
class Reconcile:
    """How findings of a print reconcile rank, and where each kind is put right."""

    # fixed values
    severity: dict[str, str] = field(default_factory=lambda: {"field_change": "medium", "entry_added": "high", "entry_removed": "high", "room_move": "high", "section_rename": "info"})
    field_severity: dict[str, str] = field(default_factory=dict)
    channel: dict[str, str] = field(default_factory=lambda: {"field_change": "override", "entry_added": "spreadsheet", "entry_removed": "spreadsheet", "room_move": "spreadsheet", "section_rename": "spreadsheet"})
    suppress_cosmetic: bool = True
    fold_quotes: bool = True


@dataclass(frozen=True)
class Catalogue:
    normalisation: Normalisation = field(default_factory=Normalisation)
    money: Money = field(default_factory=Money)


# fixed values
RA_MEMBER_TOKENS = ("RA", "PRA", "PPRA", "HON RA", "HONRA", "RA ELECT", "EX OFFICIO")
RA_WORDS = ("ra", "pra", "ppra", "honra")
QUALIFICATION_TOKENS = (
    "RA", "PRA", "PPRA", "HON RA", "HONRA", "RA ELECT", "EX OFFICIO", "OBE", "CBE", "MBE", "DBE", "KBE", "GBE", "CH", "KCVO",
    "GCVO", "CVO", "KCB", "GCB", "DCB", "FRS", "FRSA", "FRIAS", "FRIBA", "RIBA", "RDI", "QPM", "QC", "KC",
)
ROMAN_EXCLUDED = ("mix", "di", "li", "mm", "cd", "mi", "dc")
TITLE_CASE_EXCEPTIONS = ("RA", "PRA", "PPRA", "RWS", "RE", "NEAC", "OBE", "MBE", "CBE", "USA", "UK", "NYC", "LA", "BBC", "MoMA")
# fixed values
OPENING, CLOSING, NO_BREAK_AFTER = "'\"‘“([", "'\",;:.!?)]’”", "–—"
SINGLE_QUOTES, DOUBLE_QUOTES = "‘’‚‛′", "“”„″"
ROMAN = "M{0,4}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})"
