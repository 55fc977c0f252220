"""Rules of one corpus: which records matter, how headings look, which tags texts get.

The operators take a profile as parameter; ``SLOVENIAN_LAW`` holds the rules for Slovenian acts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# The patterns, word lists and labels below must be these for right results.
_ARABIC, _ROMAN = r"\d+", r"[IVXLCDM]+"


@dataclass(frozen=True)
class Profile:
    law_codes: tuple[str, ...] = ()
    title_keywords: tuple[str, ...] = ()
    text_keywords: tuple[str, ...] = ()
    noise_prefixes: tuple[str, ...] = ()
    #: Article headings in order of priority; ``roman_articles`` only count where none of the first is found.
    articles: tuple[str, ...] = ()
    roman_articles: tuple[str, ...] = ()
    #: Those that end the leading noise of an act.
    article_lines: tuple[str, ...] = ()
    chapters: tuple[str, ...] = ()
    numbered_heading: str = ""
    paragraph: str = ""
    numbered_item: str = ""
    lettered_item: str = ""
    internal_article: str = ""
    #: Tag to law codes, and tag to words that give it.
    code_tags: dict[str, tuple[str, ...]] = field(default_factory=dict)
    word_tags: dict[str, tuple[str, ...]] = field(default_factory=dict)


SLOVENIAN_LAW = Profile(
    law_codes=("ZDoh-2", "ZDavP-2", "ZDDPO-2", "ZDDV-1", "ZTFI-1", "ZISDU-3", "ZBan-3", "ZGD-1"),
    title_keywords=(
        "dohodnina",
        "davčni postopek",
        "davek na dodano vrednost",
        "davek od dohodkov pravnih oseb",
        "trg finančnih instrumentov",
        "investicijski sklad",
        "upravljavsk",
        "bank",
        "gospodarske družbe",
        "kapital",
        "vrednostni papir",
    ),
    text_keywords=(
        "dohodnina",
        "davčni zavezanec",
        "davčna osnova",
        "davčna stopnja",
        "akontacija dohodnine",
        "dohodek iz kapitala",
        "kapitalski dobiček",
        "dobiček iz kapitala",
        "dividenda",
        "dividende",
        "obresti",
        "odsvojitev vrednostnih papirjev",
        "delnice",
        "obveznice",
        "investicijski sklad",
        "finančni instrument",
        "vrednostni papir",
        "ddv",
        "davek",
        "davčna napoved",
        "davčni organ",
        "rezident",
        "nerezident",
        "pravna oseba",
        "borzn",
    ),
    noise_prefixes=("Opozorilo:", "Neuradno prečiščeno besedilo", "Besedilo osnovnega predpisa", "ZAKON", "UREDBA", "PRAVILNIK"),
    articles=(rf"^\s*({_ARABIC})\.\s*člen\s*$", rf"^\s*({_ARABIC})\.\s*člen\b", rf"^\s*člen\s+({_ARABIC})\b"),
    roman_articles=(rf"^\s*({_ROMAN})\.\s*člen\s*$", rf"^\s*({_ROMAN})\.\s*člen\b"),
    article_lines=(rf"^\s*({_ARABIC})\.\s*člen\b", rf"^\s*člen\s+({_ARABIC})\b"),
    chapters=(
        r"(?m)^\s*([IVXLCDM]+)\.\s+[A-ZČŠŽ0-9][A-ZČŠŽ0-9\s\-\–\,/]+$",
        r"(?mi)^\s*(\d+)\.\s*(poglavje|del|oddelek)\b.*$",
        r"(?mi)^\s*(PRVI|DRUGI|TRETJI|ČETRTI|PETI|ŠESTI|SEDMI|OSMI|DEVETI|DESETI|ENAJSTI|DVANAJSTI)\s+DEL\b.*$",
    ),
    numbered_heading=r"^\s*\d+\.\s+[A-ZČŠŽ][^.;:]{1,120}$",
    paragraph=r"(?m)^\s*\((\d+)\)\s+",
    numbered_item=r"(?m)^\s*(\d+[.)])\s+",
    lettered_item=r"(?m)^\s*([a-zčšž]\))\s+",
    internal_article=rf"(?mi)^\s*(?:Article\s+(?:{_ROMAN}|\d+)|{_ROMAN}\.\s*člen(?:\s*[–-].*)?)\s*$",
    code_tags={
        "tax": ("ZDoh-2", "ZDavP-2", "ZDDPO-2", "ZDDV-1"),
        "investment": ("ZTFI-1", "ZISDU-3", "ZBan-3"),
        "income_tax": ("ZDoh-2",),
        "procedure": ("ZDavP-2",),
        "corporate_tax": ("ZDDPO-2",),
        "vat": ("ZDDV-1",),
    },
    word_tags={
        "tax": ("dohodnina", "davek", "davčni", "ddv", "davčna osnova", "davčna stopnja", "davčna napoved"),
        "income_tax": ("dohodnina", "akontacija dohodnine"),
        "capital_gains": ("kapitalski dobiček", "dobiček iz kapitala", "odsvojitev", "vrednostni papir"),
        "dividends": ("dividend",),
        "interest": ("obrest",),
        "investment": ("finančni instrument", "investicijski sklad", "delnice", "obveznice", "vrednostni papir", "upravljavska družba"),
        "corporate_tax": ("pravna oseba", "davek od dohodkov pravnih oseb"),
        "vat": ("ddv", "davek na dodano vrednost"),
        "procedure": ("davčni organ", "davčna napoved", "rok", "postopek"),
    },
)
