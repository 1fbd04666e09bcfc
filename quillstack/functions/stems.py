"""Stems of words by language, as expressions from tables of endings.

English by Porter's published steps, after irregular verbs are read as their base; other languages by light
tables of endings, each with the letters that must be left. The same tables are told in the engine's SQL and in
plain SQL. Each step is a lambda over the word before it, so that an expression grows with the steps only.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

# fixed values: Porter's classes of letters and measures of a stem, and his steps
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
SOME, TWO, VOWEL = f"^({_C})?{_V}{_C}", f"^({_C})?{_V}{_C}{_V}{_C}", f"^({_C})?[aeiouy]"
ONE, SHORT = f"^({_C})?{_V}{_C}({_V})?$", f"^{_C}[aeiouy][^aeiouwxy]$"
STEP_1 = [("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")]
STEP_2 = [
    ("ational", "ate"), ("ization", "ize"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("tional", "tion"), ("biliti", "ble"),
    ("entli", "ent"), ("ousli", "ous"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("iviti", "ive"), ("enci", "ence"), ("anci", "ance"),
    ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("ator", "ate"), ("eli", "e"),
]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", "")]
STEP_4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou"]
# fixed values: forms of common irregular verbs by base
IRREGULAR = {
    "be": "am is are was were been", "begin": "began begun", "break": "broke broken", "bring": "brought", "buy": "bought", "catch": "caught", "choose": "chose chosen",
    "come": "came", "do": "did done does", "draw": "drew drawn", "drink": "drank drunk", "drive": "drove driven", "eat": "ate eaten", "fall": "fell fallen",
    "feel": "felt", "fight": "fought", "find": "found", "fly": "flew flown", "forget": "forgot forgotten", "get": "got gotten", "give": "gave given", "go": "went gone",
    "grow": "grew grown", "have": "had has", "hear": "heard", "hide": "hid hidden", "hold": "held", "keep": "kept", "know": "knew known", "leave": "left",
    "lose": "lost", "make": "made", "meet": "met", "pay": "paid", "ride": "rode ridden", "rise": "rose risen", "run": "ran", "say": "said", "see": "saw seen",
    "sell": "sold", "send": "sent", "shake": "shook shaken", "sing": "sang sung", "sit": "sat", "sleep": "slept", "speak": "spoke spoken", "stand": "stood",
    "steal": "stole stolen", "swim": "swam swum", "take": "took taken", "teach": "taught", "tell": "told", "think": "thought", "throw": "threw thrown",
    "understand": "understood", "wake": "woke woken", "wear": "wore worn", "win": "won", "write": "wrote written",
}
# fixed values: letters read as others, and endings with what stands for them and the letters that must be left; longer ones first
LIGHT: dict[str, tuple[tuple[str, str], list[tuple[str, str, int]]]] = {
    "de": (("äöüáàâéèêíìîóòôúùû", "aouaaaeeeiiiooouuu"), [("ern", "", 3), ("em", "", 3), ("en", "", 3), ("er", "", 3), ("es", "", 3), ("e", "", 3), ("s", "", 4)]),
    "es": (("áéíóúü", "aeiouu"), [("eses", "es", 3), ("ces", "z", 2), ("os", "", 3), ("as", "", 3), ("es", "", 3), ("o", "", 3), ("a", "", 3), ("e", "", 3)]),
    "fr": (("àâäéèêëîïôöùûüç", "aaaeeeeiioouuuc"), [("issements", "ir", 3), ("issement", "ir", 3), ("ements", "", 3), ("ement", "", 3), ("eaux", "eau", 1), ("aux", "al", 2), ("euses", "eu", 3), ("euse", "eu", 3), ("eux", "eu", 3), ("ees", "", 3), ("es", "", 3), ("ee", "", 3), ("s", "", 3), ("x", "", 3), ("e", "", 3)]),
    "ru": (("ё", "е"), [("иями", "", 2), ("ями", "", 2), ("ами", "", 2), ("ией", "", 2), ("иям", "", 2), ("ием", "", 2), ("иях", "", 2), ("ого", "", 2), ("его", "", 2), ("ому", "", 2), ("ему", "", 2), ("ыми", "", 2), ("ими", "", 2), ("ов", "", 2), ("ев", "", 2), ("ей", "", 2), ("ой", "", 2), ("ий", "", 2), ("ый", "", 2), ("ая", "", 2), ("яя", "", 2), ("ое", "", 2), ("ее", "", 2), ("ые", "", 2), ("ие", "", 2), ("ых", "", 2), ("их", "", 2), ("ым", "", 2), ("им", "", 2), ("ам", "", 2), ("ям", "", 2), ("ах", "", 2), ("ях", "", 2), ("ом", "", 2), ("ем", "", 2), ("ия", "", 2), ("ья", "", 2), ("а", "", 2), ("я", "", 2), ("о", "", 2), ("е", "", 2), ("и", "", 2), ("ы", "", 2), ("у", "", 2), ("ю", "", 2), ("й", "", 2), ("ь", "", 2)]),
}


@dataclass(frozen=True)
class Dialect:
    """How an engine writes a regular expression's match and a step over a word."""

    like: Callable[[str, str], str]
    step: Callable[[str, str], str]


ENGINE = Dialect(lambda x, p: f"({x} rlike '{p}')", lambda x, body: f"element_at(transform(array({x}), w -> {body}), 1)")
PLAIN = Dialect(lambda x, p: f"regexp_matches({x}, '{p}')", lambda x, body: f"list_transform([{x}], lambda w: {body})[1]")


def _stem(ending: str, of: str = "w") -> str:
    return f"substr({of}, 1, length({of}) - {len(ending)})"


def _endings(s: Dialect, rules: Sequence[tuple[str, str]], measure: str | None) -> str:
    """The first ending that fits gives way if what is left has the measure; else the word stays."""
    out = "case"
    for ending, new in rules:
        change = f"concat({_stem(ending)}, '{new}')"
        out += f" when w like '%{ending}' then " + (change if measure is None else f"case when {s.like(_stem(ending), measure)} then {change} else w end")
    return out + " else w end"


def _porter(s: Dialect) -> list[str]:
    after = f"case when {s.like('w', '(at|bl|iz)$')} then concat(w, 'e') when {s.like('w', '(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx)$')} then {_stem('x')} when {s.like('w', SHORT)} then concat(w, 'e') else w end"
    cut = " ".join(f"when w like '%{e}' and {s.like(_stem(e), VOWEL)} then {s.step(_stem(e), after)}" for e in ("ed", "ing"))
    past = f"case when w like '%eed' then case when {s.like(_stem('eed'), SOME)} then {_stem('d')} else w end {cut} else w end"
    last = "case " + " ".join(f"when w like '%{e}' then case when {s.like(_stem(e), TWO)} then {_stem(e)} else w end" for e in STEP_4[:9]) + f" when {s.like('w', '(s|t)ion$')} then case when {s.like(_stem('ion'), TWO)} then {_stem('ion')} else w end " + " ".join(f"when w like '%{e}' then case when {s.like(_stem(e), TWO)} then {_stem(e)} else w end" for e in STEP_4[9:]) + " else w end"
    silent = f"case when w like '%e' and ({s.like(_stem('e'), TWO)} or ({s.like(_stem('e'), ONE)} and not {s.like(_stem('e'), SHORT)})) then {_stem('e')} else w end"
    double = f"case when w like '%ll' and {s.like('w', TWO)} then {_stem('l')} else w end"
    y = f"case when w like '%y' and {s.like(_stem('y'), VOWEL)} then concat({_stem('y')}, 'i') else w end"
    return ["case when w like 'y%' then concat('Y', substr(w, 2)) else w end", _endings(s, STEP_1, None), past, y, _endings(s, STEP_2, SOME), _endings(s, STEP_3, SOME), last, silent, double, "lower(w)"]


def _chained(s: Dialect, word: str, steps: Sequence[str]) -> str:
    for body in steps:
        word = s.step(word, body)
    return word


def stem_sql(s: Dialect, word: str, language: str, irregular: Mapping[str, str] | None = None) -> str:
    """The stem of a lower-case word of a language (a code; English where it has no table) as an expression."""
    told = IRREGULAR if irregular is None else irregular
    if language in LIGHT:
        (old, new), rules = LIGHT[language]
        fold = f"translate({'replace(w, chr(223), ' + chr(39) + 'ss' + chr(39) + ')' if language == 'de' else 'w'}, '{old}', '{new}')"
        ends = "case " + " ".join(f"when w like '%{e}' and length(w) >= {len(e) + least} then concat({_stem(e)}, '{x}')" for e, x, least in rules) + " else w end"
        return _chained(s, word, [fold, ends])
    forms = "case " + " ".join(f"when w in ({', '.join(repr(f) for f in forms.split())}) then '{base}'" for base, forms in told.items()) + " else w end"
    base = s.step(word, forms)
    return s.step(base, f"case when length(w) < 3 then w else {_chained(s, 'w', _porter(s))} end")


def stems_sql(s: Dialect, word: str, language: str) -> str:
    """stem_sql by a column of language codes."""
    return f"case {language} " + " ".join(f"when '{k}' then {stem_sql(s, word, k)}" for k in LIGHT) + f" else {stem_sql(s, word, 'en')} end"


def stem(word: str, language: str) -> Column:
    """The stem of a column of lower-case words, by a column of language codes."""
    return F.expr(stems_sql(ENGINE, word, language))
