"""Stems of words by their endings, in both detection languages: forms of one word mostly share one.

An ending goes if at least LEAST letters are left; the longest that fits goes. Accents of vowels don't count.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST = 3
#: Endings of nouns, adjectives and verbs (this project's own tables).
ENDINGS = {
    "es": (
        "amientos amiento imientos imiento aciones acion adores adoras ador adora andome andole andolo iendole iendolo ando iendo aron ieron aban aba amos emos imos ados adas ado ada "
        "idos idas ido ida arme arle arlo arla erle erlo irle irlo aran aria arian ar er ir iones ion eres ares ores an en es os as o a e s"
    ).split(),
    "en": "ations ation ings ing edly ed ers er ies es ness ments ment ly (?<!s)s e y".split(),
}
_PLAIN = str.maketrans("áéíóúü", "aeiouu")


def _pattern(language: str) -> str:
    endings = "|".join(sorted(ENDINGS[language], key=lambda e: (-len(e), e)))
    return rf"^(.{{{LEAST},}}?)(?:{endings})$"


def stem_of(word: str, language: str) -> str:
    """The stem of one word."""
    bare = re.sub(r"[^\w]", "", word.lower()).translate(_PLAIN)
    return re.sub(_pattern(language), r"\1", bare)


def stem(word: Column, language: str) -> Column:
    """The stem of each word, by built-in functions."""
    bare = F.translate(F.regexp_replace(F.lower(word), r"(?U)[^\w]", ""), "áéíóúü", "aeiouu")
    return F.regexp_replace(bare, _pattern(language), "$1")
