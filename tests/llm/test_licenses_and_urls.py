import pathlib
import re

import pytest

from reviewloom.llm import license_scan, url_filter


def licenses(documents, texts):
    rows = list(enumerate(texts))
    return {r.doc_id: r for r in license_scan.scan_licenses(documents(rows)).collect()}


def full(*names):
    return " ".join(license_scan.SENTENCES[n].rstrip(".") + "." for n in names)


def test_notices_full_texts_and_near_misses(documents):
    texts = [
        "Some prose.\nLicensed under the Apache License, Version 2.0.",
        "no end !!\nRELEASED   under the MIT license",
        full("mit-grant", "mit-condition").replace(" to ", "\n   to ").replace("conditions:.", "conditions:"),
        full("bsd-permitted", "bsd-source", "bsd-binary", "bsd-endorse"),
        full("bsd-permitted", "bsd-source", "bsd-binary"),
        full("bsd-source", "bsd-permitted", "bsd-binary"),
        full("mit-grant") + " One. Two. " + full("mit-condition"),
        full("mit-grant") + " One. Two. Three. " + full("mit-condition"),
        "This is not licensed under the Apache License, Version 2.0.",
        "Licensed under the MIT License. Licensed under CC BY-NC 4.0.",
        full("apache-grant"),
        None,
        "",
    ]
    got = licenses(documents, texts)
    expected = [["Apache-2.0"], ["MIT"], ["MIT"], ["BSD-3-Clause"], ["BSD-2-Clause"], [], ["MIT"], [], [], ["MIT", "CC-BY-NC-4.0"], ["Apache-2.0"], [], []]
    assert [got[i].licenses for i in range(len(texts))] == expected
    assert got[0].positions == [1] and got[9].positions == [0, 1]
    assert (got[11].n_sentences, got[12].n_sentences) == (0, 0)
    assert got[7].sentence_ids == ["mit-grant", "mit-condition"]


def test_the_sample_documents_against_plain_search(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    notices = {
        "licensed under the apache license version 2 0": "Apache-2.0",
        "released under the mit license": "MIT",
        "this work is licensed under the gnu general public license version 3": "GPL-3.0-only",
        "licensed under cc by nc 4 0": "CC-BY-NC-4.0",
    }
    expected = {}
    for r in docs.collect():
        lines = [" ".join(re.findall(r"[a-z0-9]+", line.lower())) for line in r.text.split("\n")]
        expected[r.doc_id] = [notices[x] for x in lines if x in notices]
    got = {r.doc_id: r.licenses for r in license_scan.scan_licenses(docs).collect()}
    assert got == expected and sum(map(bool, expected.values())) > 20


def named(text):
    _, found = license_scan.Sentences(license_scan.SENTENCES).identify(text.encode())
    return [name for _, name in license_scan.match_rules(found, license_scan.RULES, license_scan.GAP)]


BSD = """Copyright (c) 1998, Regents of the University of Somewhere
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:

  1. Redistributions of source code must retain the above copyright
     notice, this list of conditions and the following disclaimer.
  2. Redistributions in binary form must reproduce the above copyright
     notice, this list of conditions and the following disclaimer in the
     documentation and/or other materials provided with the distribution.
"""
GNU = """{0} is free software{1} you can redistribute it and/or modify
it under the terms of the GNU {2}General Public License as published by
the Free Software Foundation{3} either version {4} of the License, or
(at your option) any later version.
"""


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("This project is licensed under the MIT License.", ["MIT"]),
        ("This project is licensed under the MIT License - see the LICENSE file for details.", ["MIT"]),
        ("Licensed under either of the Apache License, Version 2.0 or the MIT license at your option.", ["Apache-2.0", "MIT"]),
        ("Code is licensed under the\nBSD 3-Clause License.", ["BSD-3-Clause"]),
        ("It is distributed under the terms of the GNU General Public License v2.", ["GPL-2.0-only"]),
        ("Foo is licensed under the GPLv3+.", ["GPL-3.0-or-later"]),
        ("Foo is released under the GNU Lesser General Public License, version 2.1 or later.", ["LGPL-2.1-or-later"]),
        ("Available under the Mozilla Public License, v. 2.0.", ["MPL-2.0"]),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["CC-BY-SA-4.0"]),
        ("// SPDX-License-Identifier: (MIT OR GPL-2.0+)\nint x;", ["MIT", "GPL-2.0-or-later"]),
        ("# SPDX-License-Identifier:Apache-2.0 WITH LLVM-exception", ["Apache-2.0"]),
        (GNU.format("Foo", ":", "Affero ", ",", "3"), ["AGPL-3.0-or-later"]),
        (GNU.format("This library", ";", "Lesser ", ";", "2.1"), ["LGPL-2.1-or-later"]),
        (GNU.format("This program", ";", "", ";", "2"), ["GPL-2.0-or-later"]),
        (BSD + "  3. Neither the name of Acme, Inc. nor the names of its contributors\n     may be used to endorse or promote products"
         " derived from\n     this software without specific prior written permission.\n", ["BSD-3-Clause"]),
        (BSD + "3. The name of the author may not be used to endorse or promote products derived from this software without specific"
         " prior written permission.", ["BSD-3-Clause"]),
        (BSD, ["BSD-2-Clause"]),
        ("This is free and unencumbered software released into the public domain.", ["Unlicense"]),
        ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided"
         " that the above\ncopyright notice and this permission notice appear in all copies.", ["ISC"]),
        ("This is not licensed under the MIT License. It cannot be released under GPLv2.", []),
        ("The bridge was published by the MIT press. Released by MIT in 1999. We sat under the tree.", []),
    ],
)
def test_wordings_that_the_sample_does_not_have(text, expected):
    assert named(text) == expected


@pytest.mark.parametrize("name", ["GPL-2", "GPL-3", "LGPL-2.1", "LGPL-3", "MPL-2.0", "MPL-1.1", "CC0-1.0", "Apache-2.0"])
def test_full_texts_as_systems_ship_them(name):
    path = pathlib.Path("/usr/share/common-licenses", name)
    if not path.exists():
        pytest.skip("no licence texts on this system")
    version = name if "." in name else f"{name}.0"
    text = path.read_text()
    assert named(text) == [f"{version}-only" if "GPL" in name else version]
    assert named(text[: len(text) // 2]) == []


def test_awkward_documents(documents, awkward):
    assert license_scan.scan_licenses(documents(awkward)).filter("size(licenses) = 0").count() == len(awkward)
    assert license_scan.scan_licenses(documents([])).count() == 0


URLS = [
    "http://a.net/x", "http://net/", "http://net", "http://NET/x?y", "http://cabinet/", "http://b.example.net/en/1", "http://b.example.net/en",
    "HTTPS://Example.COM/de/2#f", "http://example.com/DE/2", "http://x.example.com:80/de/", "http://w.org/fr/?", "http://w.org/en/fr/", None, "",
    "no scheme.net/", "a://b://c.net/", "http://m.casino-win.example.com/en/", "http://casinos.example.com/", "http://free-bets.example.net/en/1",
    "http://my.cheap-pills.example.com/de/3", "http://x/casino/", "http://x.net\n/y", "://h.net/p/q", "http://ÜBER.net/Ä", "http://a.net/x",
]


def plain(url):
    host, path = "", ""
    if url and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return (host, path, max(fits)[1], max(fits)[2])
    names = re.split(r"[^0-9A-Za-z]+", host)
    spam = "casino" in names or re.search(r"(?<![0-9A-Za-z])(free-bets|cheap-pills)(?![0-9A-Za-z])", host)
    return (host, path, None, "block" if spam else "allow")


def test_urls_equal_plain_rules(spark):
    rows = [(i if i % 7 else None, url, "x", "y") for i, url in enumerate(URLS)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, tokens string")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages).collect()]
    assert sorted(got, key=repr) == sorted(((i if i % 7 else None, *plain(u)) for i, u in enumerate(URLS)), key=repr)
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_rules_are_indexed_by_their_rarest_token(spark):
    pages = spark.createDataFrame([(i, f"http://a{i}.example.net/en/" if i else "http://example.com/") for i in range(9)], "page_id long, url string")
    host, path = url_filter.host_and_path(pages["url"])
    words = url_filter.F.split(url_filter.F.concat(host, path), url_filter.NOT_TOKEN)
    rules = url_filter.rules_table(spark, url_filter.ADDRESS_RULES)
    index = {r["name"]: r.token for r in url_filter.rarest_tokens(rules, pages.select(words.alias("tokens"))).collect()}
    assert index == {"net/": "net", "example.net/en/": "en", "example.com/de/": "de", "org/fr/": "fr"}


def test_a_rule_needs_a_whole_token():
    with pytest.raises(ValueError, match="no whole literal token"):
        url_filter.address_rule("block", "", "/x")
    assert url_filter.address_rule("block", "a.b", "/part").tokens == ("a", "b")


@pytest.mark.parametrize(
    ("sentence", "licences"),
    [
        ("He refused to have it released under the MIT License.", []),
        ("Nothing here is licensed under the MIT License.", []),
        ("This work is not MIT licensed.", []),
        ("None of these files are distributed under the terms of the GPL version 2.", []),
        ("This project is MIT licensed.", ["MIT"]),
        ("All files are Apache 2.0 licensed, see LICENSE.", ["Apache-2.0"]),
        ("Unless otherwise noted, code is licensed under the MIT License.", ["MIT"]),
        ("Except where otherwise stated, all content is licensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
        ("This font is licensed under the SIL Open Font License, Version 1.1.", ["OFL-1.1"]),
        ("Licensed under the EUPL v1.2", ["EUPL-1.2"]),
    ],
)
def test_notices_grant_or_deny(sentence, licences):
    assert license_scan.licences_named(license_scan.normal(sentence.encode()).decode()) == licences
