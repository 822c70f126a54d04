"""The text analyzer: tokens, folding, stoplist and plural normalisation, as columns and (for derived forms) in Python.

Words of scripts without spaces are segmented by a documented approximation: runs of Han or kana become character bigrams,
Hangul stays whole. Everything else is exact.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# These lists decide which words match, so results depend on them.
STOPWORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with"
).split()
IRREGULAR = {
    "analyses": "analysis", "theses": "thesis", "crises": "crisis", "diagnoses": "diagnosis", "prognoses": "prognosis",
    "hypotheses": "hypothesis", "parentheses": "parenthesis", "syntheses": "synthesis", "emphases": "emphasis",
    "oases": "oasis", "neuroses": "neurosis", "psychoses": "psychosis", "lenses": "lens",
}
SINGULAR_IN_S = ["alias", "bias", "atlas", "canvas", "lens", "news"]
NOUNS_IN_IE = (
    "movie cookie zombie calorie genie pixie sortie selfie smoothie hoodie newbie rookie goalie veggie birdie foodie freebie indie junkie oldie quickie talkie townie yuppie"
).split()
# End of fixed values.

SPLIT = "[\\n\\r\\p{Z}\\p{P}\\p{Sm}]+"
POSSESSIVE = "(?<=\\p{L})['’][sS](?![\\p{L}\\p{N}])"
GLUE = "-/.'’_"
_POSSESSIVE = regex.compile(POSSESSIVE)
_CAMEL = regex.compile(r"\p{Lu}+(?=\p{Lu}\p{Ll})|\p{Lu}?[\p{Ll}\p{N}\p{M}]+|\p{Lu}+[\p{N}]*|[^\p{Lu}\p{Ll}]+")
_PIECE = regex.compile(r"([^\n\r\p{Z}\p{P}\p{Sm}]+)|([\n\r\p{Z}\p{P}\p{Sm}]+)")
_MARKS = regex.compile(r"\p{M}+")
_HANGUL = regex.compile(r"\p{Hangul}")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]")
_BIGRAM = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー]+|\p{Hangul}+|[^\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]+")


@functools.cache
def _accents() -> tuple[str, str]:
    """Precomposed Latin letters and their bases, from the Unicode decompositions."""
    pairs = [(chr(k), unicodedata.normalize("NFD", chr(k))) for k in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]]
    pairs = [(c, d[0]) for c, d in pairs if len(d) > 1 and all(unicodedata.category(x)[0] == "M" for x in d[1:])]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


def _bare(text: Column) -> Column:
    """Text without possessive endings."""
    return F.when(F.contains(text, F.lit("'")) | F.contains(text, F.lit("’")), F.regexp_replace(text, POSSESSIVE, "")).otherwise(text)


def tokens(text: Column) -> Column:
    """Canonical tokens in text order, case kept (scripts without spaces are left whole)."""
    return F.filter(F.split(_bare(text), SPLIT), lambda t: t != "")


def fold(token: Column) -> Column:
    """Lower case without combining marks, for Latin letters. ASCII has none."""
    low = F.lower(token)
    return F.when(F.octet_length(token) == F.length(token), low).otherwise(F.regexp_replace(F.translate(low, *_accents()), "\\p{M}+", ""))


def singular(w: Column) -> Column:
    """Plural to singular, for lower-case words. The exceptions are one constant map, which keeps the generated code small enough to be compiled."""
    held = IRREGULAR | {x: x for x in SINGULAR_IN_S} | {x + "s": x for x in NOUNS_IN_IE}
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in held.items() for x in pair]), w)
    n = F.length(w)
    less = lambda k: F.substring(w, F.lit(1), n - k)
    rules = (
        F.when(w.endswith("ies") & (n > 4), F.concat(less(3), F.lit("y")))
        .when(w.rlike("(?:sses|(?s:.)(?:ches|shes)|(?s:..)(?:xes|zes|ses))\\z"), less(2))
        .when(w.rlike("[^suio]s\\z"), less(1))
        .otherwise(w)
    )
    return F.when((n <= 3) | ~w.endswith("s"), w).otherwise(F.coalesce(known, rules))


def term(token: Column, keep_stopwords: bool = False) -> Column:
    """The indexed form of a token, or null for a stopword."""
    folded = fold(token)
    return singular(folded) if keep_stopwords else F.when(~folded.isin(STOPWORDS), singular(folded))


# The same in Python, for queries (driver side) and derived forms.


def has_cjk(text: str) -> bool:
    return not text.isascii() and bool(_CJK.search(text))


def fold_text(text: str) -> str:
    text = text.lower()
    return text if has_cjk(text) else _MARKS.sub("", unicodedata.normalize("NFD", text))


def singular_text(w: str) -> str:
    if len(w) <= 3 or w in SINGULAR_IN_S:
        return w
    if w in IRREGULAR:
        return IRREGULAR[w]
    if w.endswith("ies") and len(w) > 4:
        return w[:-1] if w[:-1] in NOUNS_IN_IE else w[:-3] + "y"
    for suffixes, cut in ((("sses",), 2), (("ches", "shes", "xes", "zes", "ses"), 2)):
        if w.endswith(suffixes) and len(w) > 4:
            return w[:-cut]
    return w[:-1] if w.endswith("s") and not w.endswith(("ss", "us", "is", "os")) else w


def segments(fragment: str) -> list[str]:
    if not has_cjk(fragment):
        return [fragment]
    out: list[str] = []
    for run in _BIGRAM.findall(fragment):
        if has_cjk(run) and not _HANGUL.match(run) and len(run) > 2:
            out += [run[k : k + 2] for k in range(len(run) - 1)]
        else:
            out.append(run)
    return out


def camel_parts(token: str) -> list[str]:
    """Parts at lower-to-upper changes and before the last capital of an acronym; letters and digits never part."""
    if token.isascii() and token.isalnum() and (token.islower() or token.isdigit()):
        return []
    parts = _CAMEL.findall(token)
    return parts if len(parts) > 1 and "".join(parts) == token else []


def tokenize(text: str, derived: bool = True) -> list[str]:
    """Canonical tokens; with derived, camel-case parts after a token and glued compounds after a run."""
    text = text or ""
    if "'" in text or "’" in text:
        text = _POSSESSIVE.sub("", text)
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if derived and len(run) > 1:
            out.append("".join(run))
        run.clear()

    for word, gap in _PIECE.findall(text):
        if not word:
            if any(c not in GLUE for c in gap):
                flush()
        elif has_cjk(word):
            flush()
            out += segments(word)
        else:
            out.append(word)
            if derived:
                out += camel_parts(word)
            run.append(word)
    flush()
    return out


def query_terms(query: str) -> list[str]:
    """Indexed forms of a query's tokens, derived ones included, one for each occurrence; stopwords stay if there is nothing else."""
    every = [fold_text(t) for t in tokenize(query)]
    kept = [t for t in every if t not in STOPWORDS]
    return [singular_text(t) for t in (kept or every)]


def tokenize_udf() -> Callable[[Column], Column]:
    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: tokenize(t or ""))

    return run
