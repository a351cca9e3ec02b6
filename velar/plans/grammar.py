"""A small grammar for patterns: plain words, sequences of digits, labels with a value behind them, and phrases of names.

Words are written as people write them: a blank is any white space, a full stop may be missing unless it stands behind a
single letter, an accent may be missing, and letter case is up to whoever uses the pattern.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

ACCENTS = {"á": "[áa]", "é": "[ée]", "í": "[íi]", "ó": "[óo]", "ú": "[úu]", "ü": "[üu]"}
START, END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
#: What may stand between a label and its value: white space, a colon, and some way to say "number".
MARK = r"(?:\s+|[:#.]|n[ºo°](?!\p{L})|n(?![\p{L}\p{N}])|n[úu]m(?:ero)?(?!\p{L})|number(?!\p{L})){0,5}"


#: Ways to write "number" in front of one, which labels name by #.
NUMBER_SIGN = r"(?:n[ºo°]?\.?[ºo°]?|n[úu]m(?:ero)?\.?)"
#: Classes of tokens that values are made of.
CLASSES = {"letters": "[A-Z]", "digits": r"\d", "capital": r"\p{Lu}", "letter": r"\p{L}"}


@dataclass(frozen=True)
class Token:
    """A token of a value: `least` to `most` characters of a class, each of `times` many tokens behind one of the signs `after`.

    Without a lower bound, 0, the token may be missing. most None: any number. A blank among `after` is any white space,
    and may be missing where `loose` is set.
    """

    kind: str
    least: int
    most: int | None
    after: str = ""
    loose: bool = False
    times: int = 1

    def pattern(self) -> str:
        size = f"{{{max(1, self.least)},{'' if self.most is None else self.most}}}"
        signs = "".join(r"\s" if c == " " else re.escape(c) for c in self.after)
        one = (f"[{signs}]" + "?" * self.loose if signs else "") + CLASSES[self.kind] + size
        return f"(?:{one}){{{min(self.least, 1)},{self.times}}}" if self.times > 1 or not self.least else one


def sequence(*tokens: Token) -> str:
    """A pattern for tokens one after another."""
    return "".join(t.pattern() for t in tokens)


def spelled(words: str) -> str:
    """A pattern for one word or group of words; [word] may be missing, # says "number", `.?` is a stop that may be missing."""
    out, each = {".": r"\.?"} | ACCENTS, []
    for w in words.split():
        bare = w.strip("[]")
        if bare == "#":
            one = NUMBER_SIGN
        elif re.fullmatch(r"\w\.", bare):
            one = rf"{bare[0]}\."
        else:
            one = "".join(out.get(c) or re.escape(c) for c in bare.replace(".?", "."))
        each.append(rf"(?:{one}\s+)?" if w.startswith("[") else one + r"\s+")
    if words.split()[-1].startswith("["):
        last = each.pop()
        each[-1] = each[-1].removesuffix(r"\s+") + rf"(?:\s+{last[3:].removesuffix(r'\s+)?')})?"
        return "".join(each)
    return "".join(each).removesuffix(r"\s+")


def any_of(words: Iterable[str]) -> str:
    """A pattern for any of them, the longest first."""
    return "(?:" + "|".join(spelled(w) for w in sorted(words, key=lambda w: (-len(w), w))) + ")"


def groups(separator: str, *sizes: int | str) -> str:
    """Runs of digits with the separator between them; a size is a number or a range such as '7,8'."""
    return separator.join(rf"\d{{{n}}}" for n in sizes)


def labelled(labels: Iterable[str], value: str, between: str = MARK) -> str:
    """A pattern whose group 1, at its end, is the value behind one of the labels; labels in any letter case."""
    return rf"{START}(?iu:{any_of(labels)})(?![\p{{L}}\p{{N}}]){between}({value})"


def words(first: str, more: str, most: int, **limits) -> str:
    """A pattern for a first word and further ones, as phrase() takes them."""
    return first + phrase(more, most, **limits)


def phrase(word: str, most: int, join: str = r"\s+", particles: Iterable[str] = (), stops: Iterable[str] = (), least: int = 1) -> str:
    """A pattern for `least` to `most` words, each behind a join and any number of particles, none of them a stop word."""
    small = rf"(?:{any_of(particles)}\s+)*" if particles else ""
    barred = rf"(?!{any_of(stops)}{END})" if stops else ""
    return rf"(?:{join}{small}{barred}{word}){{{least},{most}}}"


def tokens_of(words: Iterable[str]) -> list[str]:
    """For each of the words one run of small letters that any text with it has as a token, in all its spellings.

    Optional words and number signs don't count; of the others the longest whole word does. Where all are abbreviations
    with stops inside, they are one run without these, or a run for each letter with them.
    """
    plain, out = str.maketrans("áéíóúü", "aeiouu"), set()
    for w in words:
        sure = [x.replace(".?", ".") for x in w.lower().split() if not x.startswith("[") and x != "#"]
        whole = [r for x in sure if "." not in x.strip(".") for r in re.findall("[a-záéíóúñü]+", x)]
        if whole:
            best = max(whole, key=len)
            out |= {best, best.translate(plain)}
            continue
        runs = re.findall("[a-záéíóúñü]+", sure[0]) if sure else []
        if not runs:
            raise ValueError(f"no letters in {w!r}")
        out |= {"".join(runs), runs[0]}
    return sorted(out)
