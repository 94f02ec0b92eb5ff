"""Normalising, splitting and comparing words of questions and of names."""

from __future__ import annotations

import re
import unicodedata

#: Words that name no part of a schema (fixed values).
STOPWORDS = {
    "a", "an", "the", "of", "for", "in", "on", "at", "to", "and", "or", "with", "from", "as", "is", "are", "was", "were", "be",
    "been", "do", "does", "did", "show", "me", "list", "give", "get", "display", "find", "fetch", "what", "which", "who", "whose",
    "how", "that", "this", "these", "those", "please", "their", "its", "over", "into", "than", "about",
}
#: Words that ask for a grouping or an aggregate (fixed values).
CUES = {
    "by", "per", "each", "group", "grouped", "total", "number", "count", "sum", "average", "avg", "mean", "max", "maximum", "min",
    "minimum", "most", "least", "top", "highest", "lowest",
}
#: Words that ask for columns (fixed values).
PROJECTION_CUES = {"list", "show", "give", "display", "name", "names", "which", "what", "find", "return"}
#: Superlatives by the end of the scale they ask for (fixed values).
DESCENDING = {"most", "highest", "largest", "greatest", "maximum", "max", "top", "slowest", "longest", "latest", "oldest", "best"}
ASCENDING = {"least", "lowest", "smallest", "minimum", "min", "fastest", "shortest", "earliest", "newest", "bottom", "worst"}
#: Superlatives that praise or blame; what they ask for depends on the measure (fixed values).
PRAISE, BLAME = {"best", "fastest"}, {"worst", "slowest"}
#: Numbers in words (fixed values).
NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8,
    "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "twenty": 20,
}


def normalize(text: str) -> str:
    """Lower case, no marks, letters a-z and digits only, single spaces."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return " ".join(re.sub(r"[^a-z0-9\s]+", " ", plain.lower()).split())


def singularize(word: str) -> str:
    if len(word) > 4 and word.endswith("ies"):
        return word[:-3] + "y"
    if len(word) > 4 and word.endswith("ses"):
        return word[:-2]
    return word[:-1] if len(word) > 3 and word.endswith("s") and not word.endswith(("ss", "us")) else word


def raw_tokens(text: str) -> list[str]:
    return [t for t in normalize(text).split() if t not in STOPWORDS]


def tokenize(text: str) -> list[str]:
    return [singularize(t) for t in raw_tokens(text)]


def spans(tokens: list[str], n: int = 3) -> list[str]:
    """Distinct runs of up to ``n`` tokens, shorter first."""
    return list(dict.fromkeys(" ".join(tokens[i : i + k]) for k in range(1, n + 1) for i in range(len(tokens) - k + 1)))


def osa_distance(a: str, b: str) -> int:
    """Edits between two strings; exchanging neighbours is one edit, and no part is edited twice."""
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, now[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            now.append(d)
        two, one = one, now
    return one[-1]


def similarity(a: str, b: str) -> float:
    longest = max(len(a), len(b))
    return 1.0 if not longest else 1.0 - osa_distance(a, b) / longest


def number_word(token: str) -> int | None:
    return int(token) if token.isascii() and token.isdigit() else NUMBER_WORDS.get(token)


def direction(word: str, preferred: str | None = None) -> str:
    """asc or desc; praise and blame follow the measure's preferred end (higher, lower) if it has one."""
    if preferred and word in PRAISE | BLAME:
        return "desc" if (word in PRAISE) == (preferred == "higher") else "asc"
    return "asc" if word in ASCENDING else "desc"
