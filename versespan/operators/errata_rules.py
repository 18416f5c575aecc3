"""Correction rules as data."""

from __future__ import annotations

from typing import NamedTuple

from versespan.functions.core import SPACE


class Rule(NamedTuple):
    """One correction of the text of one language.

    ``steps`` are (pattern, replacement) pairs applied in order, patterns being literal
    strings or regular expressions. ``gate`` limits the rule to texts it is found in,
    ``source_number`` to one source, ``first_only`` to the first match; ``suffix`` is
    appended where the rule applied. ``hanging`` replaces every ``>`` that closes no tag.
    """

    language: str
    steps: tuple[tuple[str, str], ...]
    literal: bool = False
    gate: str | None = None
    source_number: int | None = None
    first_only: bool = False
    suffix: str = ""
    hanging: str = ""


class RowRule(NamedTuple):
    """Literal replacement in the text of one verse."""

    row_id: str
    find: str
    replacement: str


# Corrections of single verses, in the order they apply, before the tag rules.
ROWS_BEFORE_TAGS = (
    RowRule("grc/47/140/5/9", "<>", ""),
    RowRule("grc/7/490/5/24", "<>", ""),
    RowRule("grc/47/350/7/1", "<x><E>Israel.<e><q>", ""),
    RowRule("grc/47/350/7/1", "<Q>><G>Ισραηλ<g><X>", ""),
)

# Tags, literals and asides dropped from whole languages.
TAG_RULES = (
    Rule("grc", ((r"<[^>]*div[^>]*>", ""),), gate=r"</?div"),
    Rule("pl", ((r"</?b>", ""),)),
    Rule("pl", ((r"</?e>", ""),)),
    Rule("grc", ((r"</?e>", ""),)),
    Rule("grc", ((r"</?small[^>]*>", ""),)),
    Rule("grc", ((r"</?LXX[^>]*>", ""),)),
    Rule("grc", (("<WW>", ""),), literal=True),
    Rule("pl", ((SPACE + r"*\([^)]*\)", ""),), gate=r"(?s)\(.*\)", source_number=18),
    Rule("grc", (("<S>0</S>", ""),), literal=True),
    Rule("pl", (("<S>0</S>", ""),), literal=True),
)

# Corrections of single verses between the tag rules and the retagging.
ROWS_BEFORE_RETAG = (
    RowRule("grc/47/110/2/35", "<S0</S>", ""),
    RowRule("grc/47/140/5/9", "0</S>", ""),
    RowRule("grc/47/230/43/3", "<W", ""),
)

# A section mark that opens a note which is never closed.
RETAG_RULES = (
    Rule("pl", (("<CM>", "<n>"),), literal=True, gate="<CM>", first_only=True, suffix="</n>"),
)

# Words set in angle brackets that are no tags.
ROWS_AFTER_RETAG = (
    RowRule("pl/12/470/18/11", "<Albowiem", "[Albowiem"),
    RowRule("pl/12/470/18/11", "zginęło>", "zginęło]"),
    RowRule("pl/19/550/2/7", "<apostolstwo>", "[apostolstwo]"),
    RowRule("pl/12/470/6/33", "<Boga>", "[Boga]"),
    RowRule("pl/12/480/7/8", "<dokonujecie", "[dokonujecie"),
    RowRule("pl/12/480/7/8", "czynicie>", "czynicie]"),
    RowRule("pl/12/490/13/35", "<nadejdzie", "[nadejdzie"),
    RowRule("pl/12/490/13/35", "gdy>", "gdy]"),
    RowRule("pl/12/730/16/15", "<Oto", "[Oto"),
    RowRule("pl/12/730/16/15", "widziano>", "widziano]"),
    RowRule("pl/5/290/23/10", "<jak", "[jak"),
    RowRule("pl/5/290/23/10", "Nilem>", "Nilem]"),
    RowRule("pl/5/290/59/17", "<jak odzienie>", "[jak odzienie]"),
    RowRule("pl/12/490/10/42", "<mało albo>", "[mało albo]"),
    RowRule("pl/12/500/10/13", "<najemnik ucieka>", "[najemnik ucieka]"),
    RowRule("pl/12/470/18/15", "<przeciw tobie>", "[przeciw tobie]"),
    RowRule("pl/5/640/1/12", "<ty zaś>", "[ty zaś]"),
    RowRule("pl/5/640/1/12", "<przyjmij do domu>", "[przyjmij do domu]"),
    RowRule("pl/5/290/40/7", "<Rzeczywiście trawą jest naród>", "[Rzeczywiście trawą jest naród]"),
    RowRule("pl/5/290/28/1", "<urodzajnej doliny>", "[urodzajnej doliny]"),
    RowRule("pl/12/480/10/24", "<tym", "[tym"),
    RowRule("pl/12/480/10/24", "ufność>", "ufność]"),
    RowRule("pl/5/290/22/14", "<mówi", "[mówi"),
    RowRule("pl/5/290/22/14", "Zastępów>", "Zastępów]"),
    RowRule("pl/12/500/6/47", "<we Mnie>", "[we Mnie]"),
    RowRule("pl/5/290/32/19", "<Grad", "[Grad"),
    RowRule("pl/5/290/32/19", "nizinom>", "nizinom]"),
    RowRule("pl/5/290/36/11", "<Szebna i Joach>", "[Szebna i Joach]"),
)

# Morphology, doubled brackets, entities, spacing and hanging brackets.
CLOSING_RULES = (
    Rule("grc", (("κυριου <S>2962</S> <m>>", "κυριου <S>2962</S> <m>N-GSM</m>"),), literal=True),
    Rule("grc", ((">>", ">"),), literal=True),
    Rule("pl", ((">>", ">"),), literal=True),
    Rule("grc", (("<<", "<"),), literal=True),
    Rule("pl", (("<<", "<"),), literal=True),
    Rule("pl", (("&gt;", "›"),), literal=True),
    Rule("pl", (("&lt;", "‹"),), literal=True),
    Rule("pl", ((r"([.,;!?])([A-ZĄĆĘŁŃÓŚŹŻ])", "$1 $2"),)),
    Rule("la", ((r"([.,:;!?])([A-Za-z])", "$1 $2"),), gate=r"[.,:;!?][A-Zaz]"),
    Rule("pl", (), gate=">", hanging="\u203a"),
)

STAGES = (ROWS_BEFORE_TAGS, TAG_RULES, ROWS_BEFORE_RETAG, RETAG_RULES, ROWS_AFTER_RETAG,
          CLOSING_RULES)

# The one reference row missing from the published list.
MISSING_REFERENCE = {"book_number": 490, "chapter": 1, "verse": 43,
                     "b1": 100, "c1": 6, "v1": 9, "rate": 0}

# Languages whose commentary markers are repaired.
MARKER_FROM_TEXT = ("grc",)
MARKER_SPACING = ("pl", "grc", "en")
