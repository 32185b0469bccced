"""Signature rules of the license scan.

A rule is a regular expression over a text's words joined by single spaces. Rules
are grouped in tiers; a lower tier number has priority. ``RULES`` is built from the
sentences of ``license_texts``, each written by hand, and from the names below: each license
tells how it is called, and each tier the sentences in which such a name counts as a grant, a
reference or a mention.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from tessera.llm.license_texts import TEXTS


class Rule(NamedTuple):
    label: str
    tier: int
    confidence: float
    keywords: tuple[str, ...]
    pattern: str
    base: bool = False


#: The phrases every scan must report, wherever they stand.
BASE = (
    ("mit", "mit", "under the mit license"),
    ("apache-2", "apache", "apache license version 2"),
    ("cc-by-nc", "nc", "cc by nc"),
)

#: label; keywords (words, comma-separated) of which every text of the name has one; regex of its name; regex of its SPDX words.
NAMES = (
    ("mit", "mit", r"mit(?: x11)?", r"mit"),
    ("mit-0", "mit", r"mit no attribution|mit 0", r"mit 0"),
    ("apache-2", "apache,asl 2", r"apache(?: software)?(?: license)?(?: version)? 2(?: 0)?|asl 2 0", r"apache 2 0"),
    ("apache-1.1", "apache", r"apache(?: software)?(?: license)?(?: version)? 1 1", r"apache 1 1"),
    ("bsd-2-clause", "bsd,freebsd", r"(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)", r"bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)", r"bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd|old bsd)", r"bsd 4 clause"),
    ("0bsd", "bsd,free public", r"(?:bsd 0 clause|zero clause bsd|free public)", r"0bsd"),
    ("gpl-1", "gnu", r"gnu general public(?: license)? (?:version |v)1(?: 0)?", r"gpl 1 0(?: only| or later)?"),
    ("gpl-2", "gpl,gplv2,gpl2,gplversion", r"(?:gnu )?gpl ?(?:version |v)?2(?: 0)?", r"gpl 2 0(?: only| or later)?"),
    ("gpl-2", "gnu", r"gnu general public(?: license)? (?:version |v)2(?: 0)?", r"gpl 2 0(?: only| or later)?"),
    ("gpl-3", "gpl,gplv3,gpl3,gplversion", r"(?:gnu )?gpl ?(?:version |v)?3(?: 0)?", r"gpl 3 0(?: only| or later)?"),
    ("gpl-3", "gnu", r"gnu general public(?: license)? (?:version |v)3(?: 0)?", r"gpl 3 0(?: only| or later)?"),
    ("lgpl-2.1", "lgpl,lgplv2,lgpl2,lgplversion", r"(?:gnu )?lgpl ?(?:version |v)?2 1", r"lgpl 2 1(?: only| or later)?"),
    ("lgpl-2.1", "lesser", r"gnu lesser general public(?: license)? (?:version |v)2 1", r"lgpl 2 1(?: only| or later)?"),
    ("lgpl-3", "lgpl,lgplv3,lgpl3,lgplversion", r"(?:gnu )?lgpl ?(?:version |v)?3(?: 0)?", r"lgpl 3 0(?: only| or later)?"),
    ("lgpl-3", "lesser", r"gnu lesser general public(?: license)? (?:version |v)3(?: 0)?", r"lgpl 3 0(?: only| or later)?"),
    ("agpl-3", "agpl,agplv3,agpl3,agplversion", r"(?:gnu )?agpl ?(?:version |v)?3(?: 0)?", r"agpl 3 0(?: only| or later)?"),
    ("agpl-3", "affero", r"gnu affero general public(?: license)?(?: (?:version |v)3(?: 0)?)?", r"agpl 3 0(?: only| or later)?"),
    ("mpl-1.1", "mozilla", r"mozilla public(?: license)?(?: version)? 1 1", r"mpl 1 1"),
    ("mpl-2", "mozilla", r"mozilla public(?: license)?(?: version)? 2(?: 0)?", r"mpl 2 0"),
    ("mpl-2", "mpl", r"mpl 2(?: 0)?", r"mpl 2 0"),
    ("epl-1", "eclipse", r"eclipse public(?: license)?(?: version| v)? 1(?: 0)?", r"epl 1 0"),
    ("epl-2", "eclipse", r"eclipse public(?: license)?(?: version| v)? 2(?: 0)?", r"epl 2 0"),
    ("cddl-1", "cddl,common development", r"(?:common development and distribution|cddl)(?: license)?(?: version)?(?: 1 [01])?", r"cddl 1 [01]"),
    ("cpl-1", "common", r"common public(?: license)?(?: version)?(?: 1 0)?", r"cpl 1 0"),
    ("ipl-1", "ibm", r"ibm public(?: license)?(?: version)?(?: 1 0)?", r"ipl 1 0"),
    ("isc", "isc", r"isc", r"isc"),
    ("zlib", "zlib", r"zlib(?: libpng)?", r"zlib"),
    ("bsl-1", "boost", r"boost software(?: license)?(?: version)?(?: 1 0)?", r"bsl 1 0"),
    ("unlicense", "unlicense", r"unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl", r"wtfpl"),
    ("artistic-1", "artistic", r"artistic(?: license)? (?:version )?1(?: 0)?", r"artistic 1 0"),
    ("artistic-2", "artistic", r"artistic(?: license)? (?:version )?2(?: 0)?", r"artistic 2 0"),
    ("afl-3", "academic", r"academic free(?: license)?(?: version| v)?(?: 3 0)?", r"afl 3 0"),
    ("osl-3", "osl,open software", r"(?:open software|osl)(?: license)?(?: version)?(?: 3 0)?", r"osl 3 0"),
    ("eupl-1.2", "eupl,european union", r"(?:european union public|eupl)(?: license| licence)?(?: version| v)?(?: 1 [12])?", r"eupl 1 [12]"),
    ("psf-2", "python", r"python software foundation(?: license)?(?: version)?(?: 2)?", r"psf 2 0|python 2 0"),
    ("php-3", "php", r"php(?: license)? (?:version )?3(?: 0[01])?", r"php 3 0[01]?"),
    ("ruby", "ruby", r"ruby(?: s)?", r"ruby"),
    ("vim", "vim", r"vim", r"vim"),
    ("ofl-1.1", "sil", r"sil open font(?: license)?(?: version)?(?: 1 1)?", r"ofl 1 1"),
    ("postgresql", "postgresql", r"postgresql", r"postgresql"),
    ("openssl", "openssl", r"openssl", r"openssl"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)?", r"ncsa"),
    ("ms-pl", "microsoft", r"microsoft public", r"ms pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal", r"ms rl"),
    ("sspl-1", "server", r"server side public(?: license)?(?: version)?(?: 1)?", r"sspl 1 0"),
    ("busl-1.1", "business", r"business source(?: license)?(?: version)?(?: 1 1)?", r"busl 1 1"),
    ("elastic-2", "elastic", r"elastic(?: license)?(?: version)?(?: 2(?: 0)?)?", r"elastic 2 0"),
    ("upl-1", "upl,universal permissive", r"(?:universal permissive|upl)(?: license)?(?: version)?(?: 1 0)?", r"upl 1 0"),
    ("bluoak-1", "blue", r"blue oak model(?: license)?(?: 1 0 0)?", r"blueoak 1 0 0"),
    ("mulan-2", "mulan", r"mulan (?:psl|permissive software)(?: license)?(?: v2| version 2)?", r"mulanpsl 2 0"),
    ("qpl-1", "qpl,q public", r"(?:q public|qpl)(?: license)?(?: version)?(?: 1 0)?", r"qpl 1 0"),
    ("lppl-1.3", "latex", r"latex project public(?: license)?(?: version)?(?: 1 3c?)?", r"lppl 1 3[ac]?"),
    ("gfdl-1.3", "gnu", r"gnu free documentation(?: license)?(?: version)?(?: 1 [123])?", r"gfdl 1 [123](?: only| or later)?"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?", r"cc0 1 0"),
    ("cc-by", "creative", r"creative commons attribution(?: international)?(?: [1234] 0)?", r"cc by [1234] 0"),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike(?: [1234] 0)?", r"cc by sa [1234] 0"),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial(?: [1234] 0)?", r"cc by nc [1234] 0"),
    ("cc-by-nd", "creative", r"creative commons attribution no ?deriv(?:ative)?s(?: [1234] 0)?", r"cc by nd [1234] 0"),
    ("cc-by-nc-sa", "creative", r"creative commons attribution non ?commercial share ?alike(?: [1234] 0)?", r"cc by nc sa [1234] 0"),
    ("cc-by-nc-nd", "creative", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1234] 0)?", r"cc by nc nd [1234] 0"),
    ("odbl-1", "odbl,open database", r"(?:open database|odbl)(?: license)?(?: v?1 0)?", r"odbl 1 0"),
    ("odc-by-1", "odc,open data commons", r"(?:open data commons attribution|odc by)(?: license)?(?: v?1 0)?", r"odc by 1 0"),
    ("pddl-1", "pddl,public domain dedication", r"(?:public domain dedication and|pddl)(?: license)?(?: v?1 0)?", r"pddl 1 0"),
)

#: tier, confidence and sentence around a name; {n} is the name, {s} its SPDX words.
SENTENCES = (
    (1, 0.97, r"spdx license identifier (?:{s})"),
    (2, 0.95, r"(?:re)?(?:licensed|distributed|released|published|available|provided|covered|governed)(?: to you)? (?:under|by)(?: the terms of)?(?: the)? (?:{n})(?: licen[cs]e)?"),
    (3, 0.8, r"(?:under|see|to)(?: the terms (?:of|and conditions of))?(?: the)? (?:{n}) licen[cs]e"),
    (4, 0.6, r"(?:{n}) licen[cs]ed?"),
)

def rules() -> tuple[Rule, ...]:
    """All rules in order: base phrases, unique sentences, then names by sentence."""
    made = [Rule(label, 3, 0.9, (word,), phrase, True) for label, word, phrase in BASE]
    made += [Rule(label, tier, conf, (word,), pattern) for label, word, tier, conf, pattern in TEXTS]
    for tier, conf, sentence in SENTENCES:
        for label, word, name, spdx in NAMES:
            keys = ("spdx",) if "{s}" in sentence else tuple(word.split(","))
            made.append(Rule(label, tier, conf, keys, sentence.format(n=name, s=spdx)))
    return tuple(dict.fromkeys(made))  # a license with two names has its SPDX rule once


RULES = rules()


def compiled(rule: Rule) -> re.Pattern[str]:
    return re.compile(f"(?<= )(?:{rule.pattern})(?= )")
