"""English full-text matching: all query terms must occur in the message.

Terms follow the usual database text search: words are lower-cased, stop words
dropped and the rest stemmed; tokens with digits, mail addresses and host names
stay as they are; a hyphenated word counts as a whole and by its parts.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cordwood.functions.stemming import stem_words

# The English stop words.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him
his himself she her hers herself it its itself they them their theirs themselves
what which who whom this that these those am is are was were be been being have
has had having do does did doing a an the and but if or because as until while of
at by for with about against between into through during before after above below
to from up down in out on off over under again further then once here there when
where why how all any both each few more most other some such no nor not only own
same so than too very s t can will just don should now
""".split()

# Possessive quantifiers throughout: a repeated group that can backtrack recurses
# once per repeat, which a long hyphenated text would turn into a stack overflow.
_WORD = r"[\p{L}\p{N}]++"
_HYPHENATED = rf"{_WORD}(?:-{_WORD})*+"
_TOKEN = "|".join(
    (
        # mail address; tried once per run of its characters
        r"(?<![\p{L}\p{N}._+-])[\p{L}\p{N}][\p{L}\p{N}._+-]*+@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
        # protocol: no term, but what follows is read as a host
        r"(?<![\p{L}\p{N}])[A-Za-z][A-Za-z0-9+.-]*+://",
        # host name with a port, a path or both
        rf"{_HYPHENATED}(?:\.{_HYPHENATED})++(?::\p{{N}}++(?:/[^\s\x22\x27<>]*+)?|/[^\s\x22\x27<>]*+)",
        # file path, with a slash in front or between names
        r"(?<![\p{L}\p{N}/._~-])(?:~|\.{1,2})?(?:/[A-Za-z0-9_][A-Za-z0-9._-]*+)++/?+",
        r"(?<![\p{L}\p{N}/._~-])[A-Za-z_][A-Za-z0-9._-]*+(?:/[A-Za-z0-9_][A-Za-z0-9._-]*+)++(?![\p{L}])",
        # number: signed, decimal, version
        r"(?<![\p{L}\p{N}])[+-]?\p{N}++(?:\.\p{N}++)*+(?![\p{L}\p{N}])",
        # word, hyphenated word or dotted name
        rf"{_HYPHENATED}(?:\.{_HYPHENATED})*+",
    )
)
# A dotted name is a host when its last part begins with a letter.
_HOST = r"\.\p{L}[^.]*$"
# Only letters and hyphens: these are stemmed, the rest is kept as it is.
_PLAIN_WORD = r"^[\p{L}-]+$"
# A token with a slash that begins with a host name; others are file paths.
_WITH_HOST = rf"^{_HYPHENATED}(?:\.{_HYPHENATED})++(?::\p{{N}}++)?/"

# Fixed limits in bytes, rules of the text search type that is matched: longer tokens are
# not indexed and longer words not stemmed, in messages and in queries alike.
_MAX_TOKEN = 2046
_MAX_STEMMED = 1000


def tokens(lowered: str) -> str:
    """SQL for the tokens of a lower-case text; compounds also give their parts."""
    names = rf"""flatten(transform(regexp_extract_all({lowered}, r'{_TOKEN}', 0), t -> CASE
 WHEN contains(t, '@') THEN array(t)
 WHEN endswith(t, '://') THEN cast(array() AS array<string>)
 WHEN contains(t, '/') AND t RLIKE r'{_WITH_HOST}' THEN array(t, regexp_extract(t, '^[^/]*', 0), regexp_extract(t, '/.*$', 0))
 WHEN contains(t, '/') OR contains(t, ':') THEN array(t)
 WHEN contains(t, '.') AND NOT t RLIKE r'{_HOST}' AND t RLIKE r'\p{{L}}' THEN split(t, '[.]')
 ELSE array(t) END))"""
    parts = rf"""flatten(transform({names}, t -> IF(t RLIKE r'^[\p{{L}}\p{{N}}]+-[^.@/]*$',
 concat(array(t), split(t, '-')), array(t))))"""
    return f"filter({parts}, t -> octet_length(t) <= {_MAX_TOKEN})"


def stems_of(words: str) -> str:
    """SQL for the index terms of tokens: stop words out, words stemmed, no repeats."""
    kept = f"""array_distinct(filter({words},
 t -> NOT array_contains(split('{' '.join(STOP_WORDS)}', ' '), t)))"""
    stemmed = f"t RLIKE r'{_PLAIN_WORD}' AND octet_length(t) <= {_MAX_STEMMED}"
    stems = stem_words(f"filter(k, t -> {stemmed})")
    plain = f"filter(k, t -> NOT ({stemmed}))"
    return f"""flatten(transform(array({kept}), k -> array_distinct(concat({stems}, {plain}))))"""


def message_terms(column: str) -> Column:
    """All index terms of a text column."""
    return F.expr(stems_of(tokens(f"lower(`{column}`)")))


def query_terms(spark: SparkSession, query: str) -> list[str]:
    """Index terms of a search text, by the same analysis on a one-row relation."""
    one_row = spark.sql("SELECT q FROM VALUES (:q) AS t(q)", args={"q": query})
    return list(one_row.select(message_terms("q")).first()[0])


def _stable_prefix(term: str) -> str:
    """What every word with this stem begins with.

    A step either cuts a suffix or rewrites at most its last two letters
    (``-biliti`` to ``-ble``), so all but the last two letters of a stem are
    letters of the word itself.
    """
    return term[:-2]


def where_terms(df: DataFrame, stored: str, column: str, terms: list[str]) -> DataFrame:
    """Rows whose stored index terms hold every term; no terms match nothing.

    Where a row has no stored terms they are made from its text column.
    """
    if not terms:
        return df.where(F.lit(False))
    wanted = F.array(*[F.lit(term) for term in terms])
    held = F.coalesce(F.col(stored), message_terms(column))
    return df.where(F.size(F.array_intersect(held, wanted)) == len(set(terms)))


def where_text(df: DataFrame, column: str, terms: list[str]) -> DataFrame:
    """Rows whose text column holds every term; no terms match nothing.

    Words that can have one of the stems share its stable prefix. The
    substring tests on the prefixes come first and leave few rows, and within
    those rows few words, for the analysis proper.
    """
    if not terms:
        return df.where(F.lit(False))
    lowered = F.lower(F.col(column))
    prefixes = [_stable_prefix(term) for term in terms]
    cheap = [lowered.contains(prefix) for prefix in prefixes if prefix]
    rows = df.where(reduce(and_, cheap)) if cheap else df
    likely = F.filter(
        F.expr(tokens(f"lower(`{column}`)")),
        lambda t: reduce(or_, [t.startswith(prefix) for prefix in prefixes]),
    )
    wanted = F.array(*[F.lit(term) for term in terms])
    hits = F.array_intersect(F.expr(stems_of("_likely")), wanted)
    return rows.withColumn("_likely", likely).where(F.size(hits) == len(terms)).drop("_likely")
