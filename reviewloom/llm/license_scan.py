"""Licences in texts, recognised sentence by sentence.

Normalised sentences are mapped to identifiers of known licence sentences. The
identifiers of a text, in order, are matched against licence rules: sequences
of identifiers with at most a few other sentences between them. ``{}`` in a
known sentence stands for names that differ from text to text. Notices ("... is
licensed under ...") and SPDX lines are read by their grammar and the names of
the licences. A full text is known by its first and last own sentence, joined by
known sentences.
"""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import record_batch, slices, utf8
from reviewloom.llm.license_texts import TEXTS

# Sentences of well-known licences and notices, and the rules that they make up.
SENTENCES = {
    "apache-notice": "Licensed under the Apache License, Version 2.0",
    "apache-grant": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License."
    ),
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-as-is": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    ),
    "apache-limits": (
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "mit-notice": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions:"
    ),
    "mit-condition": (
        "The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software."
    ),
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl-free": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "gpl-warranty": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "gpl-details": "See the GNU General Public License for more details.",
    "bsd-permitted": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:"
    ),
    "bsd-source": (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer."
    ),
    "bsd-binary": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "bsd-endorse": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission."
    ),
    "bsd-endorse-named": (
        "Neither the name of {} nor the names of {} contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission."
    ),
    "bsd-endorse-name": (
        "Neither the name {} nor the names of {} contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission."
    ),
    "bsd-endorse-names": (
        "Neither the names of {} nor the names of {} contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission."
    ),
    "bsd-endorse-author": (
        "The name of {} may not be used to endorse or promote products derived from this software without specific "
        "prior written permission."
    ),
    "bsd-endorse-authors": (
        "The names of {} may not be used to endorse or promote products derived from this software without specific "
        "prior written permission."
    ),
    "bsd-advertise": (
        "All advertising materials mentioning features or use of this software must display the following "
        "acknowledgement:"
    ),
    "bsd-acknowledge": "This product includes software developed by {}.",
    "mit-0-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so."
    ),
    "mit-as-is": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED '
        "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    ),
    "isc-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "isc-grant-and": (
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "0bsd-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted."
    ),
    "isc-as-is": (
        'THE SOFTWARE IS PROVIDED "AS IS" AND {} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."
    ),
    "unlicense-free": "This is free and unencumbered software released into the public domain.",
    "unlicense-anyone": (
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source "
        "code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-grant": (
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and "
        "to alter it and redistribute it freely, subject to the following restrictions:"
    ),
    "zlib-origin": (
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software."
    ),
    "zlib-altered": (
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
        "software."
    ),
    "zlib-liable": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-acknowledge": (
        "If you use this software in a product, an acknowledgment in the product documentation would be appreciated but "
        "is not required."
    ),
    "zlib-acknowledge-e": (
        "If you use this software in a product, an acknowledgement in the product documentation would be appreciated but "
        "is not required."
    ),
    "zlib-notice": "This notice may not be removed or altered from any source distribution.",
    "bsl-grant": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software "
        'and accompanying documentation covered by this license (the "Software") to use, reproduce, display, '
        "distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit "
        "third-parties to whom the Software is furnished to do so, all subject to the following:"
    ),
    "mpl2-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
    ),
    "agpl3-open": (
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, "
        "specifically designed to ensure cooperation with the community in the case of network server software."
    ),
    "agpl3-network": (
        "Notwithstanding any other provision of this License, if you modify the Program, your modified version must "
        "prominently offer all users interacting with it remotely through a computer network (if your version supports "
        "such interaction) an opportunity to receive the Corresponding Source of your version by providing access to "
        "the Corresponding Source from a network server at no charge, through some standard or customary means of "
        "facilitating copying of software."
    ),
    "cc-by-nc4-notice": "Licensed under CC BY-NC 4.0",
    "cc-by4-notice": "Licensed under CC BY 4.0",
    "cc-by-sa4-notice": "Licensed under CC BY-SA 4.0",
}

#: Between two identifiers of a rule: any number of known sentences.
ANY = "*"
#: (licence, identifiers in order); where two rules start at one sentence, the one with more sentences wins.
RULES = (
    ("Apache-2.0", ("apache-grant", "apache-copy", "apache-as-is", "apache-limits")),
    ("Apache-2.0", ("apache-grant",)),
    ("Apache-2.0", ("apache-notice",)),
    ("MIT", ("mit-grant", "mit-condition")),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-licensed",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-warranty", "gpl-details")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-3.0-only", ("gpl3-notice",)),
    ("BSD-3-Clause", ("bsd-permitted", "bsd-source", "bsd-binary", "bsd-endorse")),
    *(
        (name, ("bsd-permitted", "bsd-source", "bsd-binary", *more, f"bsd-endorse{form}"))
        for form in ("", "-named", "-name", "-names", "-author", "-authors")
        for name, more in (("BSD-3-Clause", ()), ("BSD-4-Clause", ("bsd-advertise", "bsd-acknowledge")))
    ),
    ("BSD-2-Clause", ("bsd-permitted", "bsd-source", "bsd-binary")),
    ("MIT-0", ("mit-0-grant", "mit-as-is")),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-grant-and",)),
    ("0BSD", ("0bsd-grant", "isc-as-is")),
    ("Unlicense", ("unlicense-free", "unlicense-anyone")),
    ("Unlicense", ("unlicense-free",)),
    ("Zlib", ("zlib-as-is", ANY, "zlib-grant", ANY, "zlib-origin", ANY, "zlib-altered", ANY, "zlib-notice")),
    ("BSL-1.0", ("bsl-grant",)),
    ("MPL-2.0", ("mpl2-notice",)),
    ("AGPL-3.0-only", ("agpl3-open", ANY, "agpl3-network")),
    ("CC-BY-NC-4.0", ("cc-by-nc4-notice",)),
    ("CC-BY-4.0", ("cc-by4-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa4-notice",)),
)
#: Other sentences between two of a rule at most, and between known ones where ``ANY`` of them may stand.
GAP, ANY_GAP = 2, 8

_ENDS = re.compile(rb"(?<=[.!?:])[\x20\x09-\x0D]+|\n")
_PLAIN = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def normal(sentence: bytes) -> bytes:
    """Words of ASCII letters in lower case, digits and characters beyond ASCII, one space between them."""
    return b" ".join(sentence.translate(_PLAIN).split())


#: Versions of the GNU licences by their names in notices.
_GNU = {"": ("GPL", "1 2 3"), "lesser ": ("LGPL", "2.1 3"), "library ": ("LGPL", "2"), "affero ": ("AGPL", "3")}
for _word, (_family, _versions) in _GNU.items():
    for _version in _versions.split():
        for _kind, _before, _after in (("or-later", "either ", " or at your option any later version"), ("only", "", "")):
            _name = f"{_family}-{_version if '.' in _version else _version + '.0'}-{_kind}"
            if _name != "GPL-3.0-or-later":
                SENTENCES[f"free/{_name}"] = (
                    f"This program is free software you can redistribute it and or modify it under the terms of the gnu {_word}"
                    f"general public license as published by the free software foundation {_before}version {_version} of the "
                    f"license{_after}"
                )
                RULES += ((_name, (f"free/{_name}",)),)


#: What is free software, or distributed in hope, in the notices of the GNU licences.
_SUBJECT = re.compile(rb"^(?:(?!not )[^ ]+ ){1,8}?(?=is free software\b|is distributed in the hope that\b)")


def _full_texts():
    """The sentences of the full texts, and rules from the first to the last that is in no other text."""
    split = {name: [p for p in map(normal, _ENDS.split(text.encode())) if len(p.split()) > 3] for name, text in TEXTS.items()}
    known = {normal(text.encode()): name for name, text in SENTENCES.items()}
    names, rules = {}, []
    for name, parts in split.items():
        for k, part in enumerate(parts):
            same = known.get(part) or known.get(_SUBJECT.sub(b"this program ", part))
            names.setdefault(part, same or f"{name}/{k}")
    for name, parts in split.items():
        others = {p for other, own in split.items() if other != name for p in own}
        ends = [p for p in parts if p.startswith(b"end of terms and conditions")]
        terms = parts[: parts.index(ends[0])] if ends else parts
        own = [names[p] for p in terms if p not in others and names[p] not in SENTENCES and len(p.split()) > 7]
        licence = f"{name}-only" if "GPL" in name else name
        last = [names[p] for p in parts[len(terms) :] if p not in others or names[p] in SENTENCES]
        for first in own[:3]:  # titles may be missing
            rules.append((licence, (first, ANY, own[-1])))
            if last:  # with what stands below the terms
                rules.append((licence, (first, ANY, own[-1], ANY, last[-1])))
    return {name: part.decode() for part, name in names.items() if name not in SENTENCES}, tuple(rules)

_FOUND = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_sentences", pa.int64()),
        ("sentence_ids", pa.list_(pa.string())),
        ("licenses", pa.list_(pa.string())),
        ("positions", pa.list_(pa.int64())),
    ]
)


#: Names of licences in notices, in normal form; version and kind of the GNU licences are read from the name.
_V = r"(?: ?v(?:ersion)? ?| )"
_NAMES = (
    (r"(?:the )?(?:mit|expat|mit expat)", "MIT"),
    (r"mit 0|mit no attribution", "MIT-0"),
    (r"(?:asl|apache(?: software)?(?: licen[sc]e)?)" + _V + r"2(?: 0)?", "Apache-2.0"),
    (r"(?:the )?(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)", "BSD-2-Clause"),
    (r"(?:the )?(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: new or revised)?", "BSD-3-Clause"),
    (r"(?:bsd 4 clause|4 clause bsd|original bsd)", "BSD-4-Clause"),
    (r"(?:bsd zero clause|zero clause bsd|0bsd)", "0BSD"),
    (r"isc", "ISC"),
    (r"(?:unlicense|the unlicense)", "Unlicense"),
    (r"(?:zlib|zlib libpng)", "Zlib"),
    (r"(?:boost software licen[sc]e|boost|bsl)" + _V + r"1 0", "BSL-1.0"),
    (r"(?:mozilla public licen[sc]e|mpl)" + _V + r"2(?: 0)?", "MPL-2.0"),
    (r"(?:mozilla public licen[sc]e|mpl)" + _V + r"1 1", "MPL-1.1"),
    (r"(?:eclipse public licen[sc]e|epl)" + _V + r"2(?: 0)?", "EPL-2.0"),
    (r"(?:eclipse public licen[sc]e|epl)" + _V + r"1(?: 0)?", "EPL-1.0"),
    (r"artistic(?: licen[sc]e)?" + _V + r"2 0", "Artistic-2.0"),
    (r"(?:sil )?open font licen[sc]e" + _V + r"1 1|(?:sil )?ofl" + _V + r"1 1", "OFL-1.1"),
    (r"(?:european union public licen[sc]e|eupl)" + _V + r"1 2", "EUPL-1.2"),
    (r"wtfpl|do what the fuck you want to public", "WTFPL"),
    (r"(?:cc0|cc zero|creative commons zero|creative commons cc0)(?:" + _V + r"1 0)?(?: universal)?(?: public domain dedication)?", "CC0-1.0"),
)
_CC = (
    r"(?:an? )?(?:cc|creative commons) (?:by|attribution)(?P<nc> nc| non ?commercial)?"
    r"(?:(?P<sa> sa| share ?alike)|(?P<nd> nd| no ?deriv(?:ative)?s))?" + _V + r"(?P<cc>[1-4] [05])(?: international| unported| generic)?"
)
_GNU_NAME = (
    r"(?:gnu )?(?:(?P<family>lesser |library |affero )?general public licen[sc]e|(?P<short>[al]?gpl))(?: (?:as )?published by the free "
    r"software foundation)?(?:" + _V + r"|,)?(?P<version>[123](?: [01])?)(?P<later>(?: of the licen[sc]e)?"
    r" (?:or (?:at your option )?(?:any )?(?:later|newer|greater|higher)|and (?:later|above))(?: versions?)?(?: at your option)?)?(?: only)?"
)
_ONE = "|".join([rf"(?P<n{k}>{pattern})" for k, (pattern, _) in enumerate(_NAMES)] + [_CC, _GNU_NAME])
_NAME = re.compile(rf"(?:an? |the |either (?:of )?(?:the )?)*(?:{_ONE})(?: (?:open source |public )?licen[sc]e(?![a-z]))?(?: (?:agreement|terms))?")
#: Words before the verb after which a sentence grants nothing, and how many words there may be.
_DENIALS = (
    r"not|no|never|cannot|nor|neither|t|without|unless|if|whether|nothing|none|nobody|instead|"
    r"refus[a-z]*|declin[a-z]*|reject[a-z]*|den(?:y|ies|ied)|forbid[a-z]*|prohibit[a-z]*|avoid[a-z]*"
)
WORDS_BEFORE = 8
_GRANTED = rf"(?:(?:unless|except where|except as) otherwise (?:noted|stated|specified|indicated) )?(?:(?!(?:{_DENIALS}) )[^ ]+ ){{0,{WORDS_BEFORE}}}?"
_LEAD = re.compile(
    _GRANTED +
    r"(?:licensed|licenced|released|distributed|available|published|provided|covered|redistributed)"
    r" (?:(?:to you|here) )?(?:under|(?<=covered )by)(?: the)?(?: (?:terms|conditions)(?: and conditions)? of)?(?: the| both the| both| either of| either)? "
)
#: "is MIT licensed": the name stands between the verb and its participle.
_BETWEEN = re.compile(rf"{_GRANTED}(?:is|are) (?:now |also |dual )?")
_PARTICIPLE = re.compile(r" (?:open source )?licen[sc]ed")
_NEXT = re.compile(r" (?:and|or)(?: the)? ")
_TAIL = re.compile(r"(?: at your option| (?:see|please see|refer to|you may|by|as|with|which|a copy|in|for) .*| c .*)?")


def licences_named(sentence: str):
    """The licences that a notice in normal form names: lead-in, names joined by "or" and "and", a tail."""
    between = _BETWEEN.match(sentence)
    if between and (name := _NAME.match(sentence, between.end())):
        behind = _PARTICIPLE.match(sentence, name.end())
        if behind and _TAIL.fullmatch(sentence, behind.end()):
            return [x for x in [_named(name)] if x]
    lead = _LEAD.match(sentence)
    at, out = lead.end() if lead else 0, []
    while lead:
        name = _NAME.match(sentence, at)
        if not name:
            return []
        out.append(_named(name))
        at = name.end()
        joined = _NEXT.match(sentence, at)
        if not joined or not _NAME.match(sentence, joined.end()):
            break
        at = joined.end()
    return out if lead and None not in out and _TAIL.fullmatch(sentence, at) else []


def _named(name):
    for k, (_, licence) in enumerate(_NAMES):
        if name[f"n{k}"]:
            return licence
    if name["cc"]:
        kind = "".join(f"-{x}" for x in ("nc", "sa", "nd") if name[x])
        return f"CC-BY{kind.upper()}-{name['cc'].replace(' ', '.')}"
    family = name["short"].upper() if name["short"] else {"lesser ": "LGPL", "library ": "LGPL", "affero ": "AGPL"}.get(name["family"], "GPL")
    version = name["version"].replace(" ", ".")
    version = version if "." in version else f"{version}.0"
    if (family, version) not in {(f, v if "." in v else f"{v}.0") for f, all_ in _GNU.values() for v in all_.split()}:
        return None
    return f"{family}-{version}-{'or-later' if name['later'] else 'only'}"


#: Identifiers of SPDX, their short forms of the GNU licences included.
SPDX = {
    x.lower(): x
    for x in (
        "0BSD AFL-3.0 Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent "
        "BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 CC0-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 "
        "CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 ECL-2.0 EPL-1.0 EPL-2.0 "
        "EUPL-1.1 EUPL-1.2 GFDL-1.2-only GFDL-1.2-or-later GFDL-1.3-only GFDL-1.3-or-later HPND ISC LPPL-1.3c MIT MIT-0 MPL-1.1 "
        "MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA ODbL-1.0 OFL-1.1 OpenSSL OSL-3.0 PostgreSQL Python-2.0 Ruby TCL Unicode-3.0 "
        "Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1"
    ).split()
}
for _family, _version in (("GPL", "1.0"), ("GPL", "2.0"), ("GPL", "3.0"), ("LGPL", "2.0"), ("LGPL", "2.1"), ("LGPL", "3.0"), ("AGPL", "3.0")):
    for _end, _kind in (("", "only"), ("-only", "only"), ("+", "or-later"), ("-or-later", "or-later")):
        SPDX[f"{_family}-{_version}{_end}".lower()] = f"{_family}-{_version}-{_kind}"

_SPDX_LINE = re.compile(rb"SPDX-License-Identifier:[ \t]*(.*)", re.I | re.S)


def licences_of_expression(expression: str):
    """The known licences of an SPDX expression; what follows WITH is an exception, not a licence."""
    words = re.findall(r"[A-Za-z0-9.+:-]+", expression)
    out, expected = [], True
    for k, word in enumerate(words):
        if word.upper() in ("AND", "OR", "WITH"):
            expected = word.upper() != "WITH"
            if not expected:
                continue
        elif expected and (k == 0 or words[k - 1].upper() in ("AND", "OR")):
            out.append(SPDX.get(word.rstrip(".").lower()))
        elif expected or words[k - 1].upper() != "WITH":
            break  # behind the expression
    return [x for x in out if x]


FULL_SENTENCES, FULL_RULES = _full_texts()
SENTENCES |= FULL_SENTENCES
RULES += FULL_RULES

#: Words that a slot takes at most.
SLOT = 20
_NUMBERS = {b"%d" % n for n in range(30)} | {b"a", b"b", b"c", b"d", b"e", b"f", b"i", b"ii", b"iii", b"iv", b"v"}


class Sentences:
    """Known sentences by their normal form, and the word beginnings of those that lines may break."""

    def __init__(self, known):
        self.ids, self.slotted, self.beginnings = {}, {}, set()
        for name, text in known.items():
            pieces = [normal(p) for p in text.encode().split(b"{}")]
            words = pieces[0].split()
            self.beginnings.update(hash(b" ".join(words[:n])) for n in range(1, len(words) + (len(pieces) > 1)))
            if len(pieces) == 1:
                self.ids[pieces[0]] = name
                continue
            slot = rb" (?:[^ ]+ ){1,%d}?" % SLOT
            pattern = slot.join(re.escape(p) for p in pieces) if pieces[-1] else slot.join(map(re.escape, pieces[:-1])) + rb"(?: [^ ]+){1,%d}" % SLOT
            most = sum(len(p.split()) for p in pieces) + SLOT * (len(pieces) - 1)
            self.slotted.setdefault(b" ".join(words[:3]), []).append((re.compile(pattern), pieces[0] + b" ", most, name))

    def known(self, whole):
        """The identifier of a sentence, and whether a longer one may begin with it."""
        if whole in self.ids:
            return self.ids[whole], hash(whole) in self.beginnings
        longer, best = hash(whole) in self.beginnings, None
        for pattern, head, most, name in self.slotted.get(b" ".join(whole.split(b" ", 3)[:3]), ()):
            best = best or (name if pattern.fullmatch(whole) else None)
            longer = longer or whole.startswith(head) and whole.count(b" ") < most
        return best, longer and (best is None or hash(whole) in self.beginnings)

    def joined(self, parts, i, whole):
        """(last part, identifier) of the longest known sentence that starts with ``whole`` for part ``i``."""
        best, j = None, i
        while True:
            name, longer = self.known(whole)
            if name:
                best = (j, name)
            if not longer or j + 1 >= len(parts):
                return best
            j += 1
            whole = whole + b" " + parts[j]

    def identify(self, text: bytes):
        """The number of sentences, and (number of the sentence, identifier) of the known ones.

        A sentence ends at a mark before white space or at the end of a line;
        lines that together are a known sentence are joined.
        """
        raws = [p for p in _ENDS.split(text)]
        pairs = [(p, raw) for p, raw in zip(map(normal, raws), raws, strict=True) if p]
        parts, found, i, number = [p for p, _ in pairs], [], 0, 0
        while i < len(parts):
            best = self.joined(parts, i, parts[i])
            if not best and b" is " in parts[i]:
                subject = _SUBJECT.match(parts[i])
                best = self.joined(parts, i, b"this program " + parts[i][subject.end() :]) if subject else None
            if not best and parts[i].split(b" ", 1)[0] in _NUMBERS and b" " in parts[i]:
                best = self.joined(parts, i, parts[i].split(b" ", 1)[1])
            if best:
                found.append((number, best[1]))
                i = best[0]
            elif b"spdx license identifier" in parts[i]:
                i, names = self.expression(pairs, i)
                found += [(number, name) for name in names]
            elif any(verb in parts[i] for verb in (b"under", b"covered by", b" licensed", b" licenced")):
                i, names = self.notice(pairs, i)
                found += [(number, name) for name in names]
            i, number = i + 1, number + 1
        return number, found

    @staticmethod
    def expression(pairs, i):
        """(last part, identifiers) of an SPDX line."""
        line = _SPDX_LINE.search(pairs[i][1].strip())
        if not line:
            return i, []
        rest = line[1]
        if not rest.strip() and i + 1 < len(pairs):
            i, rest = i + 1, pairs[i + 1][1]
        return i, [f"is/{name}" for name in licences_of_expression(rest.decode("utf-8", "replace"))]

    @staticmethod
    def notice(pairs, i):
        """(last part, identifiers) of a notice; it may break over three lines."""
        whole, best = "", (i, [])
        for j in range(i, min(i + 3, len(pairs))):
            raw = re.sub(rb"(?<=[0-9])\+", b" or later ", pairs[j][1])
            whole = (whole + " " + normal(raw).decode("utf-8", "replace")).strip()
            if len(whole) > 400:
                break
            names = licences_named(whole)
            if names and (not best[1] or _open(pairs[j - 1][1])):
                best = (j, [f"is/{name}" for name in names])
            if not _open(pairs[j][1]):
                break
        return best


def _open(raw):
    """Whether a sentence may go on behind this part: it has no mark at its end, or one of a version or abbreviation."""
    return raw.rstrip()[-1:] not in (b".", b"!", b"?", b":") or raw.rstrip().endswith(b" v.")


def match_rules(found, rules, gap):
    """(number of the first sentence, licence) of the rules that ``found`` fulfils, left to right, no sentence twice."""
    out, i, by_first = [], 0, {}
    for name, wanted in rules:
        by_first.setdefault(wanted[0], []).append((name, wanted))
    while i < len(found):
        best = None
        if found[i][1].startswith("is/"):  # a notice or an SPDX line
            best = (1, found[i][1][3:], i + 1)
        for name, wanted in by_first.get(found[i][1], ()):
            end = None if best and len(wanted) <= best[0] else _matched(found, i, wanted, gap)
            if end:
                best = (len(wanted), name, end)
        if best:
            out.append((found[i][0], best[1]))
        i = best[2] if best else i + 1
    return out


def _matched(found, i, wanted, gap):
    """The place behind the sentences of a rule that starts at ``i``, or None."""
    at, skip = i, False
    for k, sentence in enumerate(wanted):
        if sentence == ANY:
            skip = True
            continue
        while True:
            if at >= len(found) or k and found[at][0] - found[at - 1][0] > (max(gap, ANY_GAP) if skip else gap) + 1:
                return None
            at += 1
            if found[at - 1][1] == sentence:
                break
            if not skip:
                return None
        skip = False
    return at


def _scan(known, rules, gap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sentences = Sentences(known)
        for batch in slices(batches, "text"):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                n, found = sentences.identify(text)
                matched = match_rules(found, rules, gap)
                rows.append((doc_id, n, [s for _, s in found], [m for _, m in matched], [p for p, _ in matched]))
            yield record_batch(rows, _FOUND)

    return run


def scan_licenses(docs: DataFrame, sentences=None, rules=RULES, gap=GAP) -> DataFrame:
    """doc_id, n_sentences, sentence_ids, licenses and positions, per row of ``docs``.

    ``sentence_ids`` are the known sentences in order, ``licenses`` the rules
    that they fulfil with the number of the first sentence in ``positions``.
    NULL and empty texts have no sentence. Repeated rows are scanned each; an
    empty table gives no row; other columns are not read. One pass, no shuffle.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    kinds = "doc_id long, n_sentences long, sentence_ids array<string>, licenses array<string>, positions array<long>"
    return texts.mapInArrow(_scan(sentences or SENTENCES, tuple(rules), gap), kinds)
