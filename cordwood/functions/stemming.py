"""English (Porter2) stems of an array of words, as Spark array transforms.

Every step is one ``transform`` over the array, so a word is bound once per
step and the whole stemmer stays inside the JVM. A word travels as
``struct(word, w, p1, p2)``: the word itself, its current form, and the lengths
of the parts before the regions R1 and R2.

The steps are SQL text: parsed in one go, they cost a query no more than a
name, while building them call by call takes a second.
"""

from __future__ import annotations

# Words the algorithm treats one by one.
_SPECIAL = {
    "skis": "ski",
    "skies": "sky",
    "dying": "die",
    "lying": "lie",
    "tying": "tie",
    "idly": "idl",
    "gently": "gentl",
    "ugly": "ugli",
    "early": "earli",
    "only": "onli",
    "singly": "singl",
}
_INVARIANT = ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")
_INVARIANT_AFTER_PLURAL = (
    "inning",
    "outing",
    "canning",
    "herring",
    "earring",
    "proceed",
    "exceed",
    "succeed",
)

# Suffix tables of steps 2 to 4.
_STEP2 = {
    "tional": "tion",
    "enci": "ence",
    "anci": "ance",
    "abli": "able",
    "entli": "ent",
    "izer": "ize",
    "ization": "ize",
    "ational": "ate",
    "ation": "ate",
    "ator": "ate",
    "alism": "al",
    "aliti": "al",
    "alli": "al",
    "fulness": "ful",
    "ousli": "ous",
    "ousness": "ous",
    "iveness": "ive",
    "iviti": "ive",
    "biliti": "ble",
    "bli": "ble",
    "ogi": "og",
    "fulli": "ful",
    "lessli": "less",
    "li": "",
}
_STEP3 = {
    "tional": "tion",
    "ational": "ate",
    "alize": "al",
    "icate": "ic",
    "iciti": "ic",
    "ical": "ic",
    "ful": "",
    "ness": "",
    "ative": "",
}
_STEP4 = (
    "al",
    "ance",
    "ence",
    "er",
    "ic",
    "able",
    "ible",
    "ant",
    "ement",
    "ment",
    "ent",
    "ism",
    "ate",
    "iti",
    "ous",
    "ive",
    "ize",
    "ion",
)

_V = "[aeiouy]"
_C = "[^aeiouy]"
_SHORT = f"(?:{_C}{_V}[^aeiouywxY]|^{_V}{_C})"

# First forms: a consonant y is written Y.
_PREPARED = f"""named_struct('word', x, 'w', if(contains(x, 'y'),
 regexp_replace(regexp_replace(x, '^y', 'Y'), '(?<={_V})y', 'Y'), x))"""

# R1 starts after the first consonant that follows a vowel, R2 likewise within R1.
_WITH_P1 = f"""named_struct('word', x.word, 'w', x.w, 'p1', coalesce(nullif(
 length(regexp_extract(x.w, '^(gener|commun|arsen|{_C}*{_V}+{_C})', 1)), 0), length(x.w)))"""
_WITH_P2 = f"""named_struct('word', x.word, 'w', x.w, 'p1', x.p1, 'p2', coalesce(x.p1 + nullif(
 length(regexp_extract(substring(x.w, x.p1 + 1), '^({_C}*{_V}+{_C})', 1)), 0), length(x.w)))"""

_PLURAL = f"""CASE
 WHEN x.w LIKE '%sses' THEN left(x.w, length(x.w) - 2)
 WHEN x.w RLIKE '..ie[ds]$' THEN left(x.w, length(x.w) - 2)
 WHEN x.w RLIKE 'ie[ds]$' THEN left(x.w, length(x.w) - 1)
 WHEN x.w RLIKE '{_V}.*[^us]s$' THEN left(x.w, length(x.w) - 1)
 ELSE x.w END"""

# A trailing + marks a word that lost its -ed or -ing and may need repair.
_PAST = f"""CASE
 WHEN x.w LIKE '%eed' THEN if(length(x.w) - 3 >= x.p1, left(x.w, length(x.w) - 1), x.w)
 WHEN x.w LIKE '%eedly' THEN if(length(x.w) - 5 >= x.p1, left(x.w, length(x.w) - 3), x.w)
 WHEN x.w RLIKE '{_V}.*(ed|edly|ing|ingly)$'
  THEN regexp_replace(x.w, '^(.*{_V}.*?)(?:ed|edly|ing|ingly)$', '$1+')
 ELSE x.w END"""
_REPAIRED = f"""CASE
 WHEN x.w NOT LIKE '%+' THEN x.w
 WHEN x.w RLIKE '(at|bl|iz)[+]$' THEN concat(left(x.w, length(x.w) - 1), 'e')
 WHEN x.w RLIKE '(bb|dd|ff|gg|mm|nn|pp|rr|tt)[+]$' THEN left(x.w, length(x.w) - 2)
 WHEN length(x.w) - 1 = x.p1 AND x.w RLIKE '{_SHORT}[+]$' THEN concat(left(x.w, length(x.w) - 1), 'e')
 ELSE left(x.w, length(x.w) - 1) END"""

_FINAL_Y = f"regexp_replace(x.w, '(?<=.{_C})[yY]$', 'i')"

_RESIDUAL = """CASE
 WHEN x.found = '' OR length(x.w) - length(x.found) < x.p2 THEN x.w
 WHEN x.found = 'ion' AND NOT x.w RLIKE '[st]ion$' THEN x.w
 ELSE left(x.w, length(x.w) - length(x.found)) END"""

_FINAL_E_OR_L = f"""CASE
 WHEN x.w LIKE '%e' AND (length(x.w) - 1 >= x.p2
  OR length(x.w) - 1 >= x.p1 AND NOT x.w RLIKE '{_SHORT}e$') THEN left(x.w, length(x.w) - 1)
 WHEN x.w LIKE '%ll' AND length(x.w) - 1 >= x.p2 THEN left(x.w, length(x.w) - 1)
 ELSE x.w END"""


def _constant_map(values: dict[str, str]) -> str:
    text = ",".join(f"{key}:{value}" for key, value in values.items())
    return f"str_to_map('{text}', ',', ':')"


def _derived(table: dict[str, str]) -> str:
    """Replace the longest suffix of the table when it lies in R1."""
    return f"""CASE
 WHEN x.found = '' OR length(x.w) - length(x.found) < x.p1 THEN x.w
 WHEN x.found = 'ogi' AND NOT x.w LIKE '%logi' THEN x.w
 WHEN x.found = 'li' AND NOT x.w RLIKE '[cdeghkmnrt]li$' THEN x.w
 WHEN x.found = 'ative' AND length(x.w) - 5 < x.p2 THEN x.w
 ELSE concat(left(x.w, length(x.w) - length(x.found)), {_constant_map(table)}[x.found]) END"""


def _step(words: str, rule: str) -> str:
    return f"""transform({words}, x -> named_struct('word', x.word, 'w', {rule},
 'p1', x.p1, 'p2', x.p2))"""


def _suffix_step(words: str, suffixes, rule: str) -> str:
    choices = "|".join(sorted(suffixes, key=len, reverse=True))
    found = f"""transform({words}, x -> named_struct('word', x.word, 'w', x.w, 'p1', x.p1, 'p2', x.p2,
 'found', regexp_extract(x.w, '^.*?({choices})$', 1)))"""
    return _step(found, rule)


def stem_words(words: str) -> str:
    """SQL for the stems of an array of lower-case words, in the same order."""
    states = f"transform({words}, x -> {_PREPARED})"
    states = f"transform({states}, x -> {_WITH_P1})"
    states = f"transform({states}, x -> {_WITH_P2})"
    for rule in (_PLURAL, _PAST, _REPAIRED, _FINAL_Y):
        states = _step(states, rule)
    states = _suffix_step(states, _STEP2, _derived(_STEP2))
    states = _suffix_step(states, _STEP3, _derived(_STEP3))
    states = _suffix_step(states, _STEP4, _RESIDUAL)
    states = _step(states, _FINAL_E_OR_L)
    fixed = dict(_SPECIAL)
    fixed.update({word: word for word in _INVARIANT})
    for word in _INVARIANT_AFTER_PLURAL:
        fixed.update({word: word, word + "s": word})
    return f"""transform({states}, x -> coalesce({_constant_map(fixed)}[x.word],
 if(length(x.word) < 3, x.word, replace(x.w, 'Y', 'y'))))"""
