"""Text rules that need Python: normal form C, capitalised runs, close matches. Arrow batches, never rows."""

import difflib
import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

_SPACE = re.compile(r"\s+")
_TOKEN = re.compile(r"[A-Za-z][A-Za-z0-9'\-]*")
_NUMBER = re.compile(r"(?<![\w.])[-+]?\d+(?:[.,]\d+)?(?:\s*(?:%|[A-Za-z]{1,4}\b))?")
_MENU = re.compile(r"\S+\s*(?:>|→)\s*\S+")
SHORTEST_TERM = 3
#: A sentence may begin behind one of these, or at a line's start.
_ENDS, _OPENERS = ".!?:;", "\"'“”‘’([{*_>#-•—"


def canonical_text(text: str) -> str:
    return _SPACE.sub(" ", unicodedata.normalize("NFC", text)).strip()


@F.pandas_udf(StringType())
def _canonical(texts: pd.Series) -> pd.Series:
    return texts.map(canonical_text, na_action="ignore")


def canonical(c: Column) -> Column:
    """Normal form C with white space collapsed; texts of ASCII alone, most often, are collapsed the same way."""
    return _canonical(c)


def opens_sentence(text: str, at: int) -> bool:
    """Whether what stands before a word, openers apart, is a line's start or a sentence's end."""
    head = text[:at].rstrip(" \t\r\f\v" + _OPENERS)
    return not head or head[-1] == "\n" or head[-1] in _ENDS


def capital_runs(text: str, corroborated: frozenset[str] | None = None) -> list[tuple[int, str]]:
    """(position, run) of neighbouring words that begin with a capital.

    With a set of corroborated words, one that merely opens a sentence doesn't
    count unless it is in the set or all in capitals.
    """
    runs: list[list[re.Match]] = []
    previous: re.Match | None = None
    for word in _TOKEN.finditer(text):
        w = word.group()
        named = w[0].isupper()
        if named and corroborated is not None and not (sum(map(str.isalpha, w)) > 1 and w == w.upper()):
            named = not opens_sentence(text, word.start()) or w.casefold() in corroborated
        if not named:
            previous = None
            continue
        if previous is not None and text[previous.end() : word.start()].strip(" \t") == "" and word.start() > previous.end():
            runs[-1].append(word)
        else:
            runs.append([word])
        previous = word
    return [(r[0].start(), text[r[0].start() : r[-1].end()]) for r in runs]


def numbers(text: str) -> list[tuple[int, str]]:
    return [(m.start(), _SPACE.sub(" ", m.group().strip())) for m in _NUMBER.finditer(text)]


def device_vocabulary(device_ids: Iterable[str], display_names: Iterable[str] = ()) -> frozenset[str]:
    """Names of the devices an entry is about; they are no claims."""
    ids = list(device_ids)
    products = [d.split("/", 1)[1] for d in ids if "/" in d]
    return frozenset(n.casefold() for n in [*ids, *products, *display_names] if n)


def claim_terms(statement: str, check: str, rendering: str, device_ids: Iterable[str], display_names: Iterable[str] = ()) -> list[str]:
    """Terms of a cause that a cited section must print, in order: names and numbers."""
    span = f"{statement}\n{check}"
    elsewhere = frozenset(w.group().casefold() for w in _TOKEN.finditer(rendering) if w.group()[0].isupper() and not opens_sentence(rendering, w.start()))
    known = device_vocabulary(device_ids, display_names)
    found = sorted(capital_runs(span, elsewhere) + numbers(span))
    return list(dict.fromkeys(t for _, t in found if len(t) >= SHORTEST_TERM and t.casefold() not in known))


def looks_factual(text: str) -> bool:
    """A number, a name of several words or a menu path, in a text that has a letter."""
    if not any(map(str.isalpha, text)):
        return False
    return any(" " in r or "\t" in r for _, r in capital_runs(text)) or bool(_NUMBER.search(text)) or bool(_MENU.search(text))


@F.pandas_udf(BooleanType())
def fact_shaped(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: looks_factual(t or ""))


@F.pandas_udf(ArrayType(StringType()))
def capitalised_runs(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [r for _, r in capital_runs(t or "")])


@F.pandas_udf(ArrayType(StringType()))
def close_matches(typed: pd.Series, known: pd.Series) -> pd.Series:
    """Up to three of the known strings that resemble the typed one, best first."""
    return pd.Series([[] if t is None or k is None else difflib.get_close_matches(t, list(k), n=3, cutoff=0.6) for t, k in zip(typed, known)])


# Words that a language can't do without.
FUNCTION_WORDS = {
    "en": "the of and to in is you that it for on with as are this be at or from your have not by".split(),
    "de": "der die das und ist nicht sie ein eine zu mit auf den dem von für im sich auch wird oder bei".split(),
    "fr": "le la les des est une et dans pour que vous sur pas avec du au ce plus qui par ou sont".split(),
    "es": "el la los las que es una y en para por con del se no su al lo como más o está".split(),
    "it": "il la di che è un una e per non con del si da sono le della gli nel alla o come".split(),
}


def function_word_detector(languages: Iterable[str] = tuple(FUNCTION_WORDS)) -> "callable":
    """A detector by function words: the language most of whose words occur; its confidence is its share of all that do."""
    known = {lang: frozenset(FUNCTION_WORDS[lang]) for lang in languages}

    def detect(texts: list[str]) -> list[tuple[str | None, float]]:
        out: list[tuple[str | None, float]] = []
        for text in texts:
            words = re.findall(r"[^\W\d_]+", text.casefold())
            hits = {lang: sum(w in ws for w in words) for lang, ws in known.items()}
            best, total = max(hits, key=hits.get), sum(hits.values())
            out.append((best, hits[best] / total) if total else (None, 0.0))
        return out

    return detect
