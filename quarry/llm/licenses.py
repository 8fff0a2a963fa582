"""Licence scans by sentence rules: normalised sentences become licence-sentence identifiers, and sequences of those licences.

A text is cut into sentences and each is brought into a normal form: words in lower case without marks, articles or punctuation, in which the ways of granting
("licensed under the terms of"), the names of licences, their versions and "or any later version" are one symbol each. The table of known sentences is kept in that form, as
a trie from words to identifiers; what a sentence holds of it, the longest first, gives its identifiers. Rules, from the most specific to the least, are sequences of
identifiers; a match names a licence and uses its sentences up. Identifiers that no rule uses and that don't belong to the text of a licence found are reported as unknown.
One sentence may grant several licences ("MIT or Apache-2.0"): each name after the first is an identifier of its own. A name that stands alone is a heading, which counts
where no other sentence of the text names its family. A grant under a licence whose name isn't known is unknown, too.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Symbols of the normal form: @ a way of granting, = a licence's name, ? a name that isn't known, # a version, + "or any later version".

#: Known sentences, or the parts of them that don't vary, by identifier. What is in [ ] may be missing, and / parts alternatives.
SENTENCES: dict[str, list[str]] = {
    "statement": ["@ = [#] [+]", "license = [#] [+]", "= [#] [+] applies"],
    "unnamed": ["@ ? [#] [+]"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining copy of this software and associated documentation files"],
    "mit-notice": ["above copyright notice and this permission notice shall be included in all copies or substantial portions of software"],
    "isc-grant": ["permission to use copy modify and [or] distribute this software for any purpose with or without fee is hereby granted"],
    "isc-notice": ["provided that above copyright notice and this permission notice appear in all copies"],
    "0bsd-grant": ["permission to use copy modify and [or] distribute this software for any purpose with or without fee is hereby granted software is provided as is"],
    "as-is": ["software is provided as is", "software is provided by author/authors as is", "this software is provided as is"],
    "bsd-grant": ["redistribution and use in source and binary forms with or without modification are permitted"],
    "bsd-source": ["redistributions of source code must retain above copyright notice"],
    "bsd-binary": ["redistributions in binary form must reproduce above copyright notice"],
    "bsd-advert": ["all advertising materials mentioning features or use of this software must display following acknowledgement/acknowledgment"],
    "bsd-name": ["may be used to endorse or promote products derived from this software without [specific] prior [written] permission", "may be used to endorse or promote products"],
    "bsd-warranty": ["as is and any express or implied warranties"],
    "apache-compliance": ["you may not use this file/work/software/program/project except in compliance with license"],
    "apache-copy": ["you may obtain copy of license at"],
    "apache-warranty": ["unless required by applicable law or agreed to in writing software distributed under license is distributed"],
    "gnu-grant": [
        "free software you can redistribute it and or modify it @ = as published by free software foundation # of license [+]",
        "free software you can redistribute it and or modify it @ = # [of license] [+] [as published by free software foundation]",
        "free software you can redistribute it and or modify it @ = [as published by free software foundation]",
    ],
    "gnu-warranty": ["without even implied warranty of merchantability or fitness for particular purpose"],
    "gnu-copy": ["you should have received copy of ="],
    "mpl-copy": ["if copy of = was not distributed with this file you can obtain one at"],
    "mpl-contents": ["contents of this file are @ = [#]"],
    "zlib-grant": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"],
    "zlib-origin": ["origin of this software must not be misrepresented"],
    "zlib-altered": ["altered source versions must be plainly marked as such"],
    "boost-grant": ["permission is hereby granted free of charge to any person or organization obtaining copy of software and accompanying documentation covered by this license"],
    "postgresql-grant": ["permission to use copy modify and distribute this software and its documentation for any purpose without fee and without written agreement is hereby granted"],
    "hpnd-grant": ["permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"],
    "epl-accompanying": ["this program and accompanying materials are [made] @ = [#]"],
    "wtfpl": ["you just do what fuck you want to"],
    "unlicense": ["this is free and unencumbered software released into public domain"],
    "cc0-waiver": ["person who associated work with this deed has dedicated work to public domain", "waived all copyright and related or neighboring rights"],
    "public-domain": ["is/are/placed/released/dedicated in/into/to public domain", "dedicate this/it/work/software to public domain"],
    "reserved": ["all rights reserved"],
    "no-copy": ["may/must not be copied/reproduced/redistributed/distributed/republished"],
    "no-consent": [f"without {words} permission/consent" for words in ("prior", "express", "written", "prior written", "express written", "prior express", "prior express written", "express prior written", "explicit written", "explicit")],
}

#: What is known only in its place: where a name ends, or as a whole sentence, alternatives aside. "unnamed-heading" is a name that isn't known and a version, alone.
PLACED: dict[str, list[str]] = {"alternative": ["[or/and] = [#] [+]"], "heading": ["= [#] [+]"]}

#: Licences' names in the normal form's words, by family. Those in ONLY_GRANTED are names only after a way of granting.
NAMES: dict[str, list[str]] = {
    "MIT": ["mit license", "mit x11 license", "x11 license", "expat license"],
    "Apache": ["apache license", "apache software license", "apache public license"],
    "GPL": ["gnu general public license", "gnu gpl", "gnu public license", "gnu gpl license"],
    "LGPL": ["gnu lesser general public license", "gnu library general public license", "gnu lgpl", "lesser general public license", "library general public license"],
    "AGPL": ["gnu affero general public license", "gnu agpl", "affero general public license", "affero gpl"],
    "GFDL": ["gnu free documentation license", "gfdl"],
    "MPL": ["mozilla public license"],
    "EPL": ["eclipse public license"],
    "CPL": ["common public license"],
    "CDDL": ["common development and distribution license"],
    "EUPL": ["european union public license", "european union public licence"],
    "BSL": ["boost software license"],
    "Zlib": ["zlib license", "zlib libpng license"],
    "ISC": ["isc license"],
    "BSD": ["bsd license", "berkeley software distribution license"],
    "BSD-3-Clause": ["new bsd license", "modified bsd license", "revised bsd license", "3 clause bsd license", "bsd 3 clause license", "3 clause bsd", "bsd 3 clause"],
    "BSD-2-Clause": ["simplified bsd license", "freebsd license", "2 clause bsd license", "bsd 2 clause license", "2 clause bsd", "bsd 2 clause"],
    "BSD-4-Clause": ["4 clause bsd license", "bsd 4 clause license", "original bsd license", "4 clause bsd", "bsd 4 clause"],
    "Artistic": ["artistic license", "perl artistic license"],
    "AFL": ["academic free license"],
    "OSL": ["open software license"],
    "OFL": ["sil open font license", "open font license"],
    "PSF": ["python software foundation license", "psf license"],
    "PostgreSQL": ["postgresql license"],
    "MS-PL": ["microsoft public license"],
    "Unlicense": ["unlicense"],
    "WTFPL": ["wtfpl", "do what fuck you want to public license"],
    "CC0": ["cc0", "creative commons zero", "creative commons cc0", "cc0 license", "creative commons public domain dedication"],
    "ODbL": ["open database license"],
}
ONLY_GRANTED: dict[str, list[str]] = {
    "MIT": ["mit", "expat", "x11"],
    "Apache": ["apache", "asl"],
    "GPL": ["gpl", "gpl license"],
    "LGPL": ["lgpl", "lgpl license"],
    "AGPL": ["agpl", "agpl license"],
    "MPL": ["mpl"],
    "EPL": ["epl"],
    "CDDL": ["cddl"],
    "EUPL": ["eupl"],
    "Zlib": ["zlib"],
    "ISC": ["isc"],
    "BSD": ["bsd"],
}
#: Creative Commons: attribution with conditions, spelt out or short.
for _parts in ("by", "by nc", "by nd", "by sa", "by nc nd", "by nc sa", "by nd nc", "by sa nc"):
    _long = _parts.replace("by", "attribution").replace("nc", "noncommercial").replace("nd", "noderivatives").replace("sa", "sharealike")
    _old = _long.replace("noderivatives", "noderivs")
    _spread = _long.replace("noncommercial", "non commercial").replace("noderivatives", "no derivatives").replace("sharealike", "share alike")
    _family = "CC-" + _parts.upper().replace(" ", "-").replace("ND-NC", "NC-ND").replace("SA-NC", "NC-SA")
    NAMES.setdefault(_family, []).extend([f"{head} {x}{tail}" for head in ("creative commons", "cc") for x in dict.fromkeys((_parts, _long, _old, _spread)) for tail in ("", " license")])

VERBS = "licensed released distributed available published provided shared covered used redistributed offered issued".split()
TERMS = ["", "of", "terms of", "terms and conditions of", "conditions of", "terms of use of"]
GRANTS = [f"{v} {t}".strip() for v, t in product([*(f"{v} under" for v in VERBS), "covered by", "governed by", "subject to"], TERMS)] + [f"under {t}" for t in TERMS if t]
#: Verbs after which any name of a licence is one; after the others it must be a "public license".
GRANTING = ("licensed", "released", "distributed", "redistributed", "published", "provided", "available")
#: Words before "license" that name none.
UNNAMED = frozenset("this that these those following same above below your their his her our its such another other different separate similar any valid own license under of and or to in by for with is are may".split())
LATER = ["or at your option any later version", "or any later version", "or at your option any later", "or any later", "or later", "or newer", "or later version", "or at its option any later version", "or greater"]


@dataclass(frozen=True)
class Rule:
    """``licence`` for the sentences with these identifiers in a row, at most ``gap`` other sentences between two of them. A licence ``=`` is what the sentence names."""

    licence: str
    sentences: tuple[str, ...]
    kind: str = "permissive"
    gap: int = 2


#: In this order.
RULES = (
    Rule("=", ("spdx",), "declared"),
    Rule("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-name")),
    Rule("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    Rule("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty")),
    Rule("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    Rule("BSD", ("bsd-grant",)),
    Rule("MIT", ("mit-grant", "mit-notice", "as-is")),
    Rule("MIT", ("mit-grant", "mit-notice")),
    Rule("MIT-0", ("mit-grant", "as-is"), gap=1),
    Rule("ISC", ("isc-grant", "isc-notice", "as-is")),
    Rule("ISC", ("isc-grant", "isc-notice")),
    Rule("0BSD", ("0bsd-grant",)),
    Rule("ISC", ("isc-grant", "as-is")),
    Rule("ISC", ("isc-grant",)),
    Rule("Zlib", ("zlib-grant", "zlib-origin", "zlib-altered"), gap=4),
    Rule("Zlib", ("zlib-grant",)),
    Rule("BSL-1.0", ("boost-grant",)),
    Rule("PostgreSQL", ("postgresql-grant",)),
    Rule("HPND", ("hpnd-grant",)),
    Rule("=", ("statement", "apache-compliance", "apache-copy", "apache-warranty"), gap=3),
    Rule("=", ("statement", "apache-compliance")),
    Rule("Unlicense", ("unlicense",), "public domain"),
    Rule("WTFPL", ("wtfpl",)),
    Rule("=", ("gnu-grant", "gnu-warranty", "gnu-copy"), gap=3),
    Rule("=", ("gnu-grant",)),
    Rule("=", ("epl-accompanying",)),
    Rule("=", ("mpl-contents",)),
    Rule("=", ("statement", "mpl-copy")),
    Rule("=", ("statement",)),
    Rule("=", ("alternative",)),
    Rule("=", ("heading",)),
    Rule("CC0-1.0", ("cc0-waiver",), "public domain"),
    Rule("public domain", ("public-domain",), "public domain"),
    Rule("proprietary", ("no-copy", "no-consent"), "proprietary", 0),
    Rule("proprietary", ("reserved",), "proprietary"),
)
#: Kinds of families whose sentences don't tell.
KINDS = {"GPL": "copyleft", "LGPL": "copyleft", "AGPL": "copyleft", "GFDL": "copyleft", "MPL": "copyleft", "EPL": "copyleft", "CPL": "copyleft", "CDDL": "copyleft", "EUPL": "copyleft", "OSL": "copyleft", "ODbL": "copyleft", "CC0": "public domain", "Unlicense": "public domain"}
#: Alone these say nothing.
WEAK = ("no-copy", "no-consent")
#: The version of a family that has but one; others have that which the text gives.
ONLY_VERSION = {"BSL": "1.0", "CC0": "1.0", "PSF": "2.0"}
UNVERSIONED = ("MIT", "Zlib", "ISC", "BSD", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "PostgreSQL", "Unlicense", "WTFPL", "MS-PL")
#: How identifiers are written.
SPDX = {
    x.lower(): x
    for x in "MIT MIT-0 ISC Unlicense 0BSD Zlib Apache-1.1 Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 MPL-1.1 MPL-2.0 EPL-1.0 EPL-2.0 CDDL-1.0 EUPL-1.2 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 OFL-1.1 PostgreSQL WTFPL".split()
}

_MARK = re.compile(r"(?m)^[ \t]*(?:/\*+|\*+/|//+|#+|\*+|;+|--|<!--|-->|\"{3}|'{3})[ \t]?")
_QUOTES = str.maketrans({"“": '"', "”": '"', "„": '"', "‘": "'", "’": "'", "`": "'", " ": " "})
#: An SPDX expression, while operators are told by case and a line's end still ends it. Its operators become &, | and ~.
_EXPRESSION = re.compile(r"(?i:spdx-license-identifier):[ \t]*(?:\([ \t]*)*[\w.+-]+(?:[ \t]*\))*(?:[ \t]+(?:AND|OR|WITH)[ \t]+(?:\([ \t]*)*[\w.+-]+(?:[ \t]*\))*)*")
_OPERATOR = re.compile(r"[ \t]+(AND|OR|WITH)[ \t]+")
#: A sentence's end; the point of "v. 2.0" is none.
_END = re.compile(r"(?<=[.!?])(?<!\bv\.)(?<!\bver\.)\s+|\s*\n\s*\n\s*")
_WORD = re.compile(r"spdx-license-identifier: ?([\w.+()&|~-]+)|(\d+(?:\.\d+)*)(\+)?|[^\W\d_]+")
_ARTICLES = frozenset("a an the either".split())
_NUMBERS = {"two": "2", "three": "3", "four": "4"}
_VERSION = frozenset("version v ver".split())


def _words(sentence: str) -> list[tuple[str, str]]:
    """(word, value) of a sentence in lower case, without articles and the word version before a number; the value tells numbers, and is an SPDX expression."""
    words: list[tuple[str, str]] = []
    for m in _WORD.finditer(sentence.replace("licence", "license")):
        if m[1]:
            words.append(("spdx", m[1]))
        elif m[2]:
            if words and words[-1][0] in _VERSION:
                words.pop()
            elif words and words[-1][0] in ("gplv", "lgplv", "agplv"):
                words[-1] = (words[-1][0][:-1], "")
            words.append((m[2], "number"))
            if m[3]:
                words.append(("+", ""))
        elif m[0] not in _ARTICLES:
            if m[0] == "clause" and words and words[-1][0] in _NUMBERS:
                words[-1] = (_NUMBERS[words[-1][0]], "number")
            words.append((m[0], ""))
    return words


def _plain(phrase: str) -> tuple[str, ...]:
    return tuple(w for w, _ in _words(phrase))


def _expanded(entry: str) -> Iterator[tuple[str, ...]]:
    """The sequences that an entry of the table stands for."""
    choices = []
    for part in re.findall(r"\[[^]]*\]|\S+", entry):
        choices.append([(), *(tuple(x.split()) for x in part[1:-1].split("/"))] if part[0] == "[" else [(x,) for x in part.split("/")])
    for chosen in product(*choices):
        yield tuple(x for part in chosen for x in part)


class _Trie:
    """From sequences of words to what they mean."""

    def __init__(self, entries: Iterator[tuple[tuple[str, ...], str]]):
        self.root: dict = {}
        for sequence, meaning in entries:
            node = self.root
            for word in sequence:
                node = node.setdefault(word, {})
            node.setdefault(None, meaning)

    def longest(self, words: list[tuple[str, str]], at: int) -> tuple[int, str]:
        """The end and the meaning of the longest sequence that begins at a place; the place itself if there is none."""
        node, end, meaning = self.root, at, ""
        for k in range(at, len(words)):
            node = node.get(words[k][0])
            if node is None:
                break
            if None in node:
                end, meaning = k + 1, node[None]
        return end, meaning


_ALL_NAMES = [(_plain(x), f"={family}") for names in (NAMES, ONLY_GRANTED) for family, own in names.items() for x in own]
_PHRASES = _Trie(
    [
        *((_plain(x), "@") for x in GRANTS),
        *((_plain(x), "+") for x in LATER),
        *((_plain(x), f"={family}") for family, names in NAMES.items() for x in names),
    ]
)
_GRANTED = _Trie(_ALL_NAMES)


def _listed(out: list[tuple[str, str]]) -> bool:
    """Whether a further name of a list may follow: what was put ends with a name, with its version if it has one, or with such a name and "or" or "and"."""
    k = len(out) - 1
    if k > 0 and out[k][0] in ("or", "and"):
        k -= 1
    while k > 0 and out[k][0] in "#+":
        k -= 1
    return k >= 0 and out[k][0] == "="


def _names_licensed(words: list[tuple[str, str]], at: int) -> tuple[int, int]:
    """The place of "licensed" if names, with their versions, stand between a place and it ("Apache 2.0 licensed"), else 0; and where the names end, before which nothing has to be
    tried again."""
    k, named = at, 0
    while True:
        end, _ = _GRANTED.longest(words, k)
        if end == k:
            return 0, k
        k = named = end
        while k < len(words) and (words[k][1] == "number" or words[k][0] == "+"):
            k = named = k + 1
        if k < len(words) and words[k][0] in ("or", "and"):
            k += 1
        if k < len(words) and words[k][0] == "licensed":
            return (k if k == named and _PHRASES.longest(words, k)[1] != "@" else 0), k


def _unnamed(words: list[tuple[str, str]], at: int, public: bool) -> int:
    """The end of a name of one to four words and "license" that begins at a place; with ``public`` only of a "public license". The place itself if there is none."""
    for k in range(at, min(at + 5, len(words))):
        word, value = words[k]
        if word == "license" and k > at:
            return k + 1 if not public or words[k - 1][0] == "public" else at
        if value or word in UNNAMED:
            break
    return at


def _with_symbols(words: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Put symbols for ways of granting, names and versions. After a way of granting, the word license, or a name, short names are names too."""
    out: list[tuple[str, str]] = []
    at, licensed, tried = 0, 0, 0
    while at < len(words):
        if at == licensed and at:
            at += 1
            continue
        if at >= tried:
            licensed, tried = _names_licensed(words, at)
            if licensed:
                out.append(("@", "licensed"))
        end, meaning = _GRANTED.longest(words, at) if out and (out[-1][0] in ("@", "license") or _listed(out)) else (at, "")
        if end == at:
            end, meaning = _PHRASES.longest(words, at)
        if end == at and out and out[-1][0] == "@":
            end, meaning = _unnamed(words, at, out[-1][1] not in GRANTING), "?"
        if end > at:
            out.append((meaning[0], words[at][0] if meaning == "@" else meaning[1:]))
            at = end
        else:
            word, value = words[at]
            out.append(("#", word) if value == "number" else (word, value))
            at += 1
    return out


def _forms(table: dict[str, list[str]]) -> _Trie:
    return _Trie([(tuple(w for w, _ in _with_symbols([(w, "") for w in sequence])), name) for name, entries in table.items() for entry in entries for sequence in _expanded(entry)])


_KNOWN = _forms(SENTENCES)
_FURTHER = _forms({"alternative": PLACED["alternative"]})
_HEADING = _forms({"heading": PLACED["heading"]})


_COMMON = ("just", "want", "what", "this", "with", "from")


def _rarest(words: list[str]) -> str:
    return max(words, key=len)


def _anchors() -> tuple[str, ...]:
    """Words of which every known sentence has one, whatever stands for its symbols: the longest plain word of each, or, of those that only have symbols beside
    short words, that of each name."""
    found = {"spdx"}
    for entries in SENTENCES.values():
        for entry in entries:
            for sequence in _expanded(entry):
                plain = [w for w in sequence if w not in "@=?#+" and len(w) > 3 and w not in _COMMON]
                if plain:
                    found.add(_rarest(plain))
                else:
                    found |= {_rarest(x.split()) for names in (NAMES, ONLY_GRANTED) for own in names.values() for x in own}
    found = {"licen" if x.startswith("licen") else x for x in found}
    return tuple(sorted(x for x in found if not any(y != x and y in x for y in found)))


ANCHORS = tuple(x for x in _anchors() if len(x) > 3 or x not in ("mit", "cc", "isc", "asl"))
#: Names that are part of many other words, as words of their own.
_SHORT = re.compile(r"\b(?:mit|isc|asl|cc|x11)\b")
_GRANTING = ("under", "covered", "governed", "subject")


def may_hold(whole: str) -> bool:
    """Whether a known sentence can be in a text, given in lower case: all have an anchor."""
    return any(x in whole for x in ANCHORS) or any(x in whole for x in _GRANTING) and _SHORT.search(whole) is not None


def normal_form(sentence: str) -> list[tuple[str, str]]:
    """(word or symbol, value) of a sentence in lower case; the value is a version, a family, or an SPDX expression."""
    return _with_symbols(_words(sentence))


def normalised(text: str) -> list[list[tuple[str, str]]]:
    """The normal forms of the sentences of a whole text; none if it can't hold a known one."""
    if not may_hold(text.lower()):
        return []
    plain = _MARK.sub("", text.translate(_QUOTES))
    plain = _EXPRESSION.sub(lambda m: re.sub(r"[ \t]", "", _OPERATOR.sub(lambda o: {"AND": "&", "OR": "|", "WITH": "~"}[o[1]], m[0])), plain)
    return [normal_form(s) for s in _END.split(plain.lower()) if s.strip()]


def _heading(words: list[tuple[str, str]]) -> tuple[int, str]:
    """The end and the identifier of a heading: a sentence of nothing but names and versions, or of a name that isn't known and a version with a point."""
    end, name = _HEADING.longest(words, 0)
    if end and all(w in "=#+" or w in ("or", "and") for w, _ in words[end:]):
        return end, name
    unknown = _unnamed(words, 0, False)
    if unknown and [w for w, _ in words[unknown:]] == ["#"] and "." in words[unknown][1]:
        return len(words), "unnamed-heading"
    return 0, ""


def identify(words: list[tuple[str, str]]) -> list[tuple[str, tuple[str, str, bool]]]:
    """(identifier, (family or expression, version, or later)) of the known sentences in a normal form, in order, the longest where several begin."""
    found, at, named = [], 0, False  # whether what was found last names a licence and ends here
    while at < len(words):
        if words[at][0] == "spdx":
            found.append(("spdx", (words[at][1], "", False)))
            at, named = at + 1, False
            continue
        end, name = _KNOWN.longest(words, at)
        if end == at and named:
            end, name = _FURTHER.longest(words, at)
        if end == at == 0:
            end, name = _heading(words)
        if end == at:
            at, named = at + 1, False
            continue
        part = words[at:end]
        captures = next((v for w, v in part if w == "="), ""), next((v for w, v in part if w == "#"), ""), any(w == "+" for w, _ in part)
        found.append((name, captures))
        at, named = end, bool(captures[0])
    return found


def _name(licence: str, captures: tuple[str, str, bool]) -> str:
    family, version, later = captures
    if licence != "=":
        return licence
    version = ONLY_VERSION.get(family, version)
    if family in UNVERSIONED:
        return family
    if version and "." not in version:
        version += ".0"
    return f"{family}-{version}" + ("-or-later" if later and version and family in ("GPL", "LGPL", "AGPL", "GFDL") else "") if version else family


def _names(rule: Rule, captures: tuple[str, str, bool]) -> list[tuple[str, str]]:
    """(licence, kind) that a match names: one, or those of an SPDX expression, each with its exception."""
    if rule.sentences != ("spdx",):
        family = captures[0] if rule.licence == "=" else ""
        return [(_name(rule.licence, captures), "creative commons" if family.startswith("CC-") else KINDS.get(family, rule.kind))]
    parts = [[x.strip(".") for x in part.split("~")] for part in re.split(r"[&|()]+", captures[0])]
    return [(" WITH ".join([SPDX.get(part[0], part[0].rstrip("-")), *part[1:]]), _declared(part[0], rule.kind)) for part in parts if part[0]]


#: Kinds of SPDX identifiers by what they begin with.
_DECLARED = {x.lower().split("-")[0]: KINDS.get(x, "permissive") for x in (*NAMES, *(r.licence for r in RULES if r.kind == "permissive")) if x != "="} | {"cc": "creative commons"}


def _declared(identifier: str, unknown: str) -> str:
    return _DECLARED.get(re.split(r"[-+]", identifier)[0], unknown)


def _family(licence: str) -> str:
    return licence if licence.startswith("CC-") else licence.split("-")[0]


def _belongs(name: str, licence: str) -> bool:
    """Whether a sentence is of a kind that the licence's text has."""
    head = name.split("-")[0]
    return name == "as-is" or licence.lower().startswith(head) or head == "gnu" and "GPL" in licence or head == "apache" and licence.startswith("Apache")


def scan(text: str | None) -> tuple[list[str], list[tuple[str, str]]]:
    """(identifiers in order, (licence, kind) in order of their first sentence).

    An identifier that no rule uses gives the licence ``unknown``, unless it says nothing alone, stands between the sentences of a licence found, or beside them and is of a
    kind that its text has.
    """
    marks = [(at, name, captures) for at, s in enumerate(normalised(text or "")) for name, captures in identify(s)]
    places: dict[str, list[int]] = {}
    for k, (_, name, _) in enumerate(marks):
        places.setdefault(name, []).append(k)
    used: set[int] = set()
    found: list[tuple[int, int, str, str]] = []
    spans: list[tuple[int, int, int, str]] = []
    for rule in RULES:
        size = len(rule.sentences)
        for k in places.get(rule.sentences[0], ()):
            part = range(k, k + size)
            if k + size > len(marks) or any(i in used or marks[i][1] != name for i, name in zip(part, rule.sentences, strict=True)):
                continue
            if "apache-compliance" in rule.sentences and marks[k][2][0] != "Apache" or "mpl-copy" in rule.sentences and marks[k][2][0] != "MPL":
                continue
            if all(marks[i + 1][0] - marks[i][0] - 1 <= rule.gap for i in part[:-1]):
                used.update(part)
                names = _names(rule, marks[k][2])
                if rule.sentences == ("heading",) and any(_family(licence) == _family(names[0][0]) for _, _, licence, _ in found):
                    continue
                found += [(k, i, licence, kind) for i, (licence, kind) in enumerate(names)]
                spans.append((k, k + size - 1, rule.gap, names[0][0] if names else ""))
    # what belongs to a licence's text beyond the sentences of its rule isn't another licence
    of_licence = used | {k for name in WEAK for k in places.get(name, ())}
    for first, last, gap, licence in spans:
        for step, edge in ((-1, first), (1, last)):
            k = edge + step
            while 0 <= k < len(marks) and k not in used and abs(marks[k][0] - marks[edge][0]) - 1 <= max(gap, 3) and _belongs(marks[k][1], licence):
                of_licence.add(k)
                edge, k = k, k + step
    found += [(k, 0, "unknown", "unknown") for k in range(len(marks)) if k not in of_licence and (k == 0 or k - 1 in of_licence)]
    return [name for _, name, _ in marks], [(licence, kind) for _, _, licence, kind in sorted(found)]


def licences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id``, ``sentences`` (identifiers in order), ``licences`` (each once, by first place) and ``kinds``.

    A null or empty text has none. Very long texts are read whole, in linear time. Where known sentences begin at the same word the longest counts, and among rules the
    first. Repeated rows have repeated results; an empty table an empty one; other columns aren't read, so their names can't clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(x.as_py()) for x in batch.column(1)]
            kind = pa.list_(pa.string())
            cols = [pa.array([x for x, _ in found], kind), *(pa.array([list(dict.fromkeys(y[k] for y in x)) for _, x in found], kind) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["id", "sentences", "licences", "kinds"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, sentences array<string>, licences array<string>, kinds array<string>")
