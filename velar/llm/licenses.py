"""License detection with ordered signature rules.

Each license has a name, identifiers, an address and a telling clause; each of them makes a rule, a regular expression
with a priority. A rule runs only where a word that all its matches hold stands in the text. Detections are taken by priority,
then length; one that lies inside a detection already taken is suppressed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _parser as parser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LETTERS, LOWER, binaries, texts

#: The places counted as base, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: label | topic (for readers only) | identifiers | name | address | clause. Expressions over lower-cased text; an empty part is no rule.
LICENSES = r"""
apache-2.0 | apache | apache-2\.0 | apache (?:software )?licen[cs]e,? (?:version |v\.? ?)?2(?:\.0)? | apache\.org/licenses/license-2\.0 | unless required by applicable law or agreed to in writing
apache-1.1 | apache | apache-1\.1 | apache (?:software )?licen[cs]e,? (?:version |v\.? ?)?1\.1 | apache\.org/licenses/license-1\.1 | products derived from this software may not be called "apache"
apache-1.0 | apache | apache-1\.0 | apache (?:software )?licen[cs]e,? (?:version |v\.? ?)?1\.0 | apache\.org/licenses/license-1\.0 |
gpl-3.0 | gpl | gpl-?3(?:\.0)?(?:-only|-or-later|\+)? | (?:gnu )?gpl ?v?\.? ?(?:version )?3(?:\.0)? | gnu\.org/licenses/gpl-3\.0 |
gpl-2.0 | gpl | gpl-?2(?:\.0)?(?:-only|-or-later|\+)? | (?:gnu )?gpl ?v?\.? ?(?:version )?2(?:\.0)? | gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0 |
gpl-3.0-text | general public | | gnu general public licen[cs]e,?(?: as published by the free software foundation,?)?(?: either)? version 3 | | any later version\)?\.? ?this program is distributed in the hope
gpl-2.0-text | general public | | gnu general public licen[cs]e,?(?: as published by the free software foundation,?)?(?: either)? version 2 | |
gpl | general public | | gnu general public licen[cs]e | gnu\.org/licenses/gpl\b | gnu public licen[cs]e
lgpl-2.1 | lgpl | lgpl-?2\.1(?:-only|-or-later|\+)? | (?:gnu )?lgpl ?v?\.? ?(?:version )?2\.1 | gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1 |
lgpl-3.0 | lgpl | lgpl-?3(?:\.0)?(?:-only|-or-later|\+)? | (?:gnu )?lgpl ?v?\.? ?(?:version )?3(?:\.0)? | gnu\.org/licenses/lgpl-3\.0 |
lgpl | lesser general | | gnu lesser general public licen[cs]e | gnu\.org/licenses/lgpl | lesser general public licen[cs]e
agpl-3.0 | agpl | agpl-?3(?:\.0)?(?:-only|-or-later|\+)? | (?:gnu )?agpl ?v?\.? ?(?:version )?3(?:\.0)? | gnu\.org/licenses/agpl-3\.0 |
agpl | affero | | (?:gnu )?affero general public licen[cs]e | gnu\.org/licenses/agpl | interacting with it remotely through a computer network
gfdl | free documentation | gfdl-1\.[123](?:-only|-or-later)? | gnu free documentation licen[cs]e | gnu\.org/licenses/fdl | invariant sections,? (?:with )?no front-cover texts
mit | mit | mit | mit (?:/x11 |expat )?licen[cs]e | opensource\.org/licenses/mit | licen[cs]ed? under (?:the )?mit
mit-text | permission is hereby granted | | permission is hereby granted, free of charge, to any person obtaining a copy | | without limitation the rights to use, copy, modify, merge, publish
isc | isc | isc | isc licen[cs]e | opensource\.org/licenses/isc | permission to use, copy, modify, and/or distribute this software for any purpose
bsd-2-clause | bsd | bsd-2-clause | (?:2|two)[- ]clause bsd|(?:simplified|freebsd) bsd? ?licen[cs]e | opensource\.org/licenses/bsd-2-clause |
bsd-3-clause | bsd | bsd-3-clause | (?:3|three)[- ]clause bsd|(?:new|modified|revised) bsd licen[cs]e | opensource\.org/licenses/bsd-3-clause |
bsd-4-clause | bsd | bsd-4-clause | (?:4|four)[- ]clause bsd|original bsd licen[cs]e | | all advertising materials mentioning features
bsd | bsd | 0bsd | bsd(?:-style)? licen[cs]e | | licen[cs]ed? under (?:the )?bsd
bsd-text | redistributions | | redistributions? of source code must retain the above copyright | | redistributions? in binary form must reproduce the above copyright
mpl-2.0 | mozilla | mpl-2\.0 | mozilla public licen[cs]e,? (?:version |v\.? ?)?2(?:\.0)? | mozilla\.org/mpl/2\.0 | subject to the terms of the mozilla public
mpl-1.1 | mozilla | mpl-1\.1 | mozilla public licen[cs]e,? (?:version |v\.? ?)?1\.1 | mozilla\.org/mpl/mpl-1\.1 |
epl-2.0 | eclipse | epl-2\.0 | eclipse public licen[cs]e,? (?:- )?(?:version |v\.? ?)?2(?:\.0)? | eclipse\.org/legal/epl-(?:v20|2\.0) |
epl-1.0 | eclipse | epl-1\.0 | eclipse public licen[cs]e,? (?:- )?(?:version |v\.? ?)?1(?:\.0)? | eclipse\.org/legal/epl-v10 |
cddl-1.0 | common development | cddl-1\.0 | common development and distribution licen[cs]e | opensource\.org/licenses/cddl |
cpl-1.0 | common public | cpl-1\.0 | common public licen[cs]e | opensource\.org/licenses/cpl |
eupl-1.2 | european union | eupl-1\.[12] | european union public licen[cs]e | joinup\.ec\.europa\.eu/[a-z/]*eupl |
artistic-2.0 | artistic | artistic-2\.0 | artistic licen[cs]e,? (?:version |v\.? ?)?2(?:\.0)? | opensource\.org/licenses/artistic-license-2\.0 |
artistic | artistic | artistic-1\.0 | artistic licen[cs]e | opensource\.org/licenses/artistic |
zlib | zlib | zlib | zlib(?:/libpng)? licen[cs]e | opensource\.org/licenses/zlib | altered source versions must be plainly marked
bsl-1.0 | boost | bsl-1\.0 | boost software licen[cs]e | boost\.org/license_1_0 |
unlicense | unlicense | unlicense | the unlicense | unlicense\.org | free and unencumbered software released into the public domain
wtfpl | wtfpl | wtfpl | do what the f\w+ you want to public licen[cs]e | wtfpl\.net |
python-2.0 | python software | psf-2\.0|python-2\.0 | python software foundation licen[cs]e | docs\.python\.org/[23]/license |
openssl | openssl | openssl | openssl licen[cs]e | openssl\.org/source/license | developed by the openssl project
postgresql | postgresql | postgresql | postgresql licen[cs]e | postgresql\.org/about/licence |
php-3.01 | php | php-3\.01? | php licen[cs]e | php\.net/license |
ruby | ruby | ruby | ruby licen[cs]e | ruby-lang\.org/[a-z/]*license |
vim | vim | vim | vim licen[cs]e | vimhelp\.org/uganda | vim charityware
ofl-1.1 | open font | ofl-1\.1 | (?:sil )?open font licen[cs]e | scripts\.sil\.org/ofl | reserved font name
cc0-1.0 | cc0 | cc0-1\.0 | cc0 ?(?:1\.0)?(?: universal)? | creativecommons\.org/publicdomain/zero | no rights reserved
cc-by-4.0 | cc | cc[- ]by[- ]4\.0 | cc[- ]by ?4\.0 | creativecommons\.org/licenses/by/4\.0 |
cc-by-3.0 | cc | cc[- ]by[- ]3\.0 | cc[- ]by ?3\.0 | creativecommons\.org/licenses/by/3\.0 |
cc-by-sa | cc | cc[- ]by[- ]sa(?:[- ][1234]\.[05])? | cc[- ]by[- ]sa | creativecommons\.org/licenses/by-sa |
cc-by-nd | cc | cc[- ]by[- ]nd(?:[- ][1234]\.[05])? | cc[- ]by[- ]nd | creativecommons\.org/licenses/by-nd |
cc-by-nc | cc | cc[- ]by[- ]nc(?:[- ][1234]\.[05])? | cc[- ]by[- ]nc | creativecommons\.org/licenses/by-nc/ |
cc-by-nc-sa | cc | cc[- ]by[- ]nc[- ]sa(?:[- ][1234]\.[05])? | cc[- ]by[- ]nc[- ]sa | creativecommons\.org/licenses/by-nc-sa |
cc-by-nc-nd | cc | cc[- ]by[- ]nc[- ]nd(?:[- ][1234]\.[05])? | cc[- ]by[- ]nc[- ]nd | creativecommons\.org/licenses/by-nc-nd |
cc-by | cc | | cc[- ]by | creativecommons\.org/licenses/by/ |
cc-by-name | creative commons | | creative commons attribution(?: [1234]\.0)?(?: international| unported)?(?: public)? licen[cs]e | | creative commons attribution
cc-by-sa-name | creative commons | | creative commons attribution[- ]share-?alike | | under a creative commons
odbl-1.0 | open database | odbl-1\.0 | open (?:data commons open )?database licen[cs]e | opendatacommons\.org/licenses/odbl |
public-domain | public domain | | (?:in|into|to) the public domain | | dedicated to the public domain
proprietary | reserved | | all rights reserved | | no part of this (?:publication|book|work) may be reproduced
proprietary-confidential | confidential | | confidential and proprietary | | unauthorized copying of this file
bigscience-rail | rail | (?:bigscience-)?(?:bloom-)?rail-1\.0 | responsible ai licen[cs]e | huggingface\.co/[a-z/-]*rail | open rail(?:-m|\+\+)?
polyform | polyform | polyform-[a-z]+-1\.0\.0 | polyform [a-z]+ licen[cs]e | polyformproject\.org/licenses |
sspl-1.0 | server side | sspl-1\.0 | server side public licen[cs]e | mongodb\.com/licensing/server-side |
busl-1.1 | business source | busl-1\.1 | business source licen[cs]e | mariadb\.com/bsl11 | change date:? .{0,40}change licen[cs]e
elastic-2.0 | elastic | elastic-2\.0 | elastic licen[cs]e | elastic\.co/licensing/elastic-license |
ms-pl | microsoft | ms-pl | microsoft public licen[cs]e | opensource\.org/licenses/ms-pl |
ms-rl | microsoft | ms-rl | microsoft reciprocal licen[cs]e | opensource\.org/licenses/ms-rl |
afl-3.0 | academic free | afl-3\.0 | academic free licen[cs]e | opensource\.org/licenses/afl-3\.0 |
osl-3.0 | open software | osl-3\.0 | open software licen[cs]e | opensource\.org/licenses/osl-3\.0 |
ncsa | illinois | ncsa | university of illinois/ncsa open source licen[cs]e | opensource\.org/licenses/ncsa |
w3c | w3c | w3c | w3c software (?:notice and|and document) licen[cs]e | w3\.org/consortium/legal/[a-z0-9/-]*software |
ecl-2.0 | educational | ecl-2\.0 | educational community licen[cs]e | opensource\.org/licenses/ecl |
"""
NOT_LABELS = {"gpl-3.0-text": "gpl-3.0", "gpl-2.0-text": "gpl-2.0", "mit-text": "mit", "bsd-text": "bsd", "cc-by-name": "cc-by", "cc-by-sa-name": "cc-by-sa", "proprietary-confidential": "proprietary"}

#: Form of a rule around a license's part, which part, priority. Higher priorities are taken first.
FORMS = [
    (r"spdx-license-identifier:\s*(?:{0})(?![\w.])", 1, 95),
    (r"licen[cs]e(?:[ _-]?(?:id|name|type))?\s*[:=]\s*[\"'(]*(?:{0})(?![\w.])", 1, 85),
    (r"(?:licen[cs]ed|released|distributed|available|published|provided|covered|governed)\s+(?:under|by)\s+(?:the\s+)?(?:terms\s+of\s+(?:the\s+)?)?(?:{0})(?!\w)", 2, 80),
    (r"(?:{0})", 3, 75),
    (r"\b(?:{0})(?!\w)", 4, 70),
    (r"\b(?:{0})(?!\w)", 2, 50),
]


@dataclass(frozen=True)
class Rule:
    label: str
    literals: tuple[bytes, ...]
    pattern: re.Pattern
    priority: int


def _runs(parsed) -> list[tuple[str, ...]]:
    """Sets of words of a parsed expression: whatever it matches holds one of each set."""
    out, run = [], ""
    for op, value in parsed:
        if op is parser.LITERAL and chr(value) != " ":
            run += chr(value)
            continue
        out, run = out + [(run,)] * bool(run), ""
        if op is parser.SUBPATTERN:
            out += _runs(value[-1])
        elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT) and value[0] > 0:
            out += _runs(value[2])
        elif op is parser.BRANCH:
            sides = [max(_runs(x), key=_worth, default=()) for x in value[1]]
            out += [tuple(sorted({w for side in sides for w in side}))] * all(sides)
    return out + [(run,)] * bool(run)


def _worth(words: tuple[str, ...]) -> tuple[int, int]:
    return min(map(len, words), default=0), -len(words)


def literals(expression: str) -> tuple[bytes, ...]:
    """Words of which any text that the expression matches holds at least one; none if there is no such set."""
    return tuple(w.encode() for w in max(_runs(parser.parse(expression)), key=_worth, default=()))


def rules() -> list[Rule]:
    """All rules, highest priority first; some hundreds, each a form around one part of one license."""
    out = []
    for line in filter(None, LICENSES.strip().split("\n")):
        label, _, *parts = [x.strip() for x in re.split(r" \|(?= |$)", line)]
        for form, part, priority in FORMS:
            if expression := parts[part - 1] if part <= len(parts) else "":
                pattern = re.compile(form.format(expression.replace(" ", r"\s+")).encode())
                out.append(Rule(NOT_LABELS.get(label, label), literals(expression.replace(" ", r"\s+")), pattern, priority))
    return sorted(out, key=lambda r: -r.priority)


def detections(low: bytes, ordered: list[Rule]) -> list[tuple[int, int, str, int]]:
    """(start, end, label, priority) in a lower-cased text, without those inside one of higher rank, in order of place.

    Ranks go by priority, then length, then place, then label.
    """
    here: dict[bytes, bool] = {}
    found = []
    for rule in ordered:
        for word in rule.literals:
            if word not in here:
                here[word] = word in low
        if not rule.literals or any(here[word] for word in rule.literals):
            found += [(m.start(), m.end(), rule.label, rule.priority) for m in rule.pattern.finditer(low)]
    found.sort(key=lambda x: (-x[3], x[0] - x[1], x[0], x[2]))
    return sorted(_uncontained(found))


def _uncontained(ranked: list[tuple[int, int, str, int]]) -> list[tuple[int, int, str, int]]:
    """Those not inside an earlier one: no earlier one that starts no later ends no sooner (prefix maxima in a tree)."""
    place = {s: i + 1 for i, s in enumerate(sorted({x[0] for x in ranked}))}
    furthest, out = [-1] * (len(place) + 1), []
    for x in ranked:
        i, reach = place[x[0]], -1
        while i:
            reach, i = max(reach, furthest[i]), i & (i - 1)
        if reach >= x[1]:
            continue
        i = place[x[0]]
        while i < len(furthest):
            furthest[i] = max(furthest[i], x[1])
            i += i & -i
        out.append(x)
    return out


def base_places(text: bytes) -> tuple[int, list[tuple[int, str]]]:
    """Number of words, and (first word's number, label) of each place of a base phrase."""
    words = text.translate(LETTERS).split()
    flat, found = b" " + b" ".join(words) + b" ", []
    for phrase, label in BASE.items():
        needle = b" " + phrase.encode() + b" "
        at, word, counted = flat.find(needle), 0, 0
        while at >= 0:
            word, counted = word + flat.count(b" ", counted, at), at  # counts on from the last place
            found.append((word, label))
            at = flat.find(needle, at + 1)
    return len(words), sorted(found)


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, places, spans): per row of docs the base places, and the detections in bytes of the text.

    Null text counts as empty. Repeated rows each get a row; other columns are not read. Of detections of equal
    priority, length and place the first label by alphabet stands. Very long texts are read whole, in time linear in
    their length and number of places. An empty table gives an empty result.
    """
    kind = dict(docs.select(F.col(id_col)).dtypes)[id_col]
    places_type, spans_type = "array<struct<word:long,label:string>>", "array<struct<start:long,end:long,label:string,priority:int>>"

    def run(batches):
        ordered = rules()
        for batch in batches:
            n, places, spans = [], [], []
            for text in binaries(batch.column(1)):
                size, found = base_places(text)
                n.append(size)
                places.append([{"word": w, "label": x} for w, x in found])
                spans.append([{"start": s, "end": e, "label": x, "priority": p} for s, e, x, p in detections(text.translate(LOWER), ordered)])
            place = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("priority", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(places, place), pa.array(spans, span)], names=["id", "n_words", "places", "spans"])

    source = texts(docs, id_col, text_col=text_col).withColumnRenamed(id_col, "id")
    return source.mapInArrow(run, f"id {kind}, n_words long, places {places_type}, spans {spans_type}").withColumnRenamed("id", id_col)
