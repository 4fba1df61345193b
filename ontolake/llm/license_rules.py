"""Signature rules of the license scan, in order.

Each license has a label, its identifiers, and expressions written by hand for its names, addresses and notice sentences.
From a license's row come several rules of different priority: an identifier tag, a notice sentence, an address, a name
introduced by words such as "licensed under", and the bare name. All run over lower-case text.

A blank in a name or notice stands for what may part two words of running text: white space, with the marks of comments
after it, so that wrapped and commented texts are found; in notices quotes and punctuation too.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: What a blank stands for, in names and in notices.
SPACE = r"\s++(?:[*#/;%!>|\"'-]++\s*+)*+"
GAP = r"[\s\"'`*#/;,:()<>|%!-]++"
V = r"(?:(?:v\.|v|version|ver)(?: )?)?"


def spaced(pattern: str, gap: str) -> str:
    """The pattern with `gap` for each blank outside of classes."""
    out, inside = [], False
    for before, c in zip(" " + pattern, pattern):
        inside = (c == "[" or inside and c != "]") if before != "\\" else inside
        out.append(f"(?:{gap})" if c == " " and not inside else c)
    return "".join(out)


class Rule(NamedTuple):
    name: str
    label: str
    keyword: str
    pattern: re.Pattern
    priority: int
    confidence: float


class License(NamedTuple):
    label: str
    ids: str
    names: tuple[str, ...]
    urls: tuple[str, ...] = ()
    notices: tuple[str, ...] = ()


def _versions(label: str, tag: str, name: str, versions: str, url: str) -> list[License]:
    """A family whose members differ in the version alone."""
    out = []
    for v in versions.split():
        e = re.escape(v)
        short = re.escape(v.removesuffix(".0")) + (r"(?:\.0)?" if v.endswith(".0") else "")
        out.append(License(f"{label}-{v}", f"{tag}-{v} {tag}-{v}-only {tag}-{v}-or-later {tag}-{v}+", (rf"{name},? {V}{short}(?![\d.]\d)", rf"{tag}[\s-]?v?{short}(?![\d.]\d)"), (url.format(v=e, s=short),)))
    return out


def _creative_commons() -> list[License]:
    words = {"by": "attribution", "sa": "share-?\\s?alike", "nc": "non-?\\s?commercial", "nd": "no-?\\s?deriv(?:ative)?s"}
    out = []
    for kind in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"):
        parts = kind.split("-")
        short, long = r"[\s-]".join(parts), r"(?:-| )".join(words[p] for p in parts)
        for v in ("4.0", "3.0", "2.5", "2.0", "1.0"):
            e = re.escape(v)
            out.append(License(f"cc-{kind}-{v}", f"cc-{kind}-{v}", (rf"cc[\s-]{short}[\s-]v?{e}", rf"creative commons {long}(?:-| ){V}{e}"), (rf"creativecommons\.org/licenses/{kind}/{e}",)))
        out.append(License(f"cc-{kind}", f"cc-{kind}", (rf"cc[\s-]{short}(?![\w-])(?!\s\w\w\b)", rf"creative commons {long}(?!-)")))
    return out


LICENSES: tuple[License, ...] = (
    License("mit", "mit", (r"mit license", r"mit-style license", r"expat license", r"mit/x11 license", r"x11 license"), (r"opensource\.org/licenses?/mit\b", r"mit-license\.org"), (
        r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", r"the above copyright notice and this permission notice shall be included in all copies")),
    License("mit-0", "mit-0", (r"mit no attribution", r"mit-0")),
    *_versions("apache", "apache", r"apache(?: software)? license", "2.0 1.1 1.0", r"apache\.org/licenses/license-{v}"),
    License("apache", "apache", (r"apache license(?!,?(?: )?(?:version|v)?(?: )?\d)", r"apache software foundation license"), (), (
        r"licensed to the apache software foundation asf under one", r"you may not use this file except in compliance with the license", r"unless required by applicable law or agreed to in writing software")),
    *_versions("agpl", "agpl", r"(?:gnu )?affero general public license", "3.0 1.0", r"gnu\.org/licenses/agpl-{v}"),
    *_versions("lgpl", "lgpl", r"(?:gnu )?(?:lesser|library) general public license", "3.0 2.1 2.0", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-{v}"),
    *_versions("gpl", "gpl", r"(?:gnu )?general public license", "3.0 2.0 1.0", r"gnu\.org/licenses/(?:old-licenses/)?gpl-{v}"),
    *_versions("gfdl", "gfdl", r"(?:gnu )?free documentation license", "1.3 1.2 1.1", r"gnu\.org/licenses/(?:old-licenses/)?fdl-{v}"),
    License("agpl", "agpl", (r"gnu affero general public license",), (r"gnu\.org/licenses/agpl",)),
    License("lgpl", "lgpl", (r"gnu lesser general public license", r"gnu library general public license", r"\blgpl\b"), (r"gnu\.org/licenses/lgpl",)),
    License("gpl", "gpl", (r"gnu general public license", r"gnu gpl\b", r"\bgplv?[23]\b"), (r"gnu\.org/licenses/gpl\.", r"gnu\.org/copyleft/gpl"), (
        r"this (?:program|file|software) is free software you can redistribute it and or modify", r"under the terms of the gnu general public license", r"you should have received a copy of the gnu general public license", r"free software foundation either version \d")),
    License("gpl-2.0-classpath", "gpl-2.0-with-classpath-exception", (r"classpath exception", r"gpl[\s-]?v?2 with (?:the )?classpath exception")),
    License("bsd-4-clause", "bsd-4-clause bsd-4-clause-uc", (r"bsd[\s-]4[\s-]clause", r"(?:4|four)[\s-]clause bsd", r"original bsd license"), (), (r"all advertising materials mentioning features or use of this software must display",)),
    License("bsd-3-clause", "bsd-3-clause bsd-3-clause-clear", (r"bsd[\s-]3[\s-]clause", r"(?:3|three)[\s-]clause bsd", r"new bsd license", r"modified bsd license", r"revised bsd license"), (r"opensource\.org/licenses?/bsd-3-clause",), (r"neither the names? of (?s:.{1,200}?)nor the names of (?:its|their) contributors",)),
    License("bsd-2-clause", "bsd-2-clause bsd-2-clause-patent", (r"bsd[\s-]2[\s-]clause", r"(?:2|two)[\s-]clause bsd", r"simplified bsd license", r"freebsd license"), (r"opensource\.org/licenses?/bsd-2-clause",), (r"redistribution and use in source and binary forms with or without modification",)),
    License("0bsd", "0bsd", (r"\b0bsd\b", r"zero[\s-]clause bsd", r"bsd zero clause")),
    License("bsd", "bsd", (r"bsd license", r"bsd-style license", r"berkeley software distribution license")),
    License("isc", "isc", (r"isc license",), (r"opensource\.org/licenses?/isc",), (r"permission to use copy modify and(?:/or)? distribute this software for any purpose",)),
    *_versions("mpl", "mpl", r"mozilla public license", "2.0 1.1 1.0", r"mozilla\.org/mpl/{v}"),
    License("mpl", "mpl", (r"mozilla public license",), (r"mozilla\.org/mpl\b",), (r"this source code form is subject to the terms of the mozilla public",)),
    *_versions("epl", "epl", r"eclipse public license", "2.0 1.0", r"eclipse\.org/(?:legal|org/documents)/epl-(?:v{s}|{v})"),
    License("epl", "epl", (r"eclipse public license",), (r"eclipse\.org/legal/epl",)),
    License("edl-1.0", "edl-1.0", (r"eclipse distribution license",), (r"eclipse\.org/org/documents/edl",)),
    *_versions("cddl", "cddl", r"common development and distribution license", "1.1 1.0", r"opensource\.org/licenses?/cddl-?{v}"),
    License("cddl", "cddl", (r"common development and distribution license", r"\bcddl\b")),
    License("cpl-1.0", "cpl-1.0", (r"common public license",)),
    License("ipl-1.0", "ipl-1.0", (r"ibm public license",)),
    *_versions("eupl", "eupl", r"european union public licen[cs]e", "1.2 1.1 1.0", r"joinup\.ec\.europa\.eu/.{{0,80}}eupl.{{0,20}}{v}"),
    License("eupl", "eupl", (r"european union public licen[cs]e", r"\beupl\b")),
    *_versions("osl", "osl", r"open software license", "3.0 2.1 2.0 1.1 1.0", r"opensource\.org/licenses?/osl-{v}"),
    *_versions("afl", "afl", r"academic free license", "3.0 2.1 2.0 1.2 1.1", r"opensource\.org/licenses?/afl-{v}"),
    *_versions("artistic", "artistic", r"artistic license", "2.0 1.0", r"opensource\.org/licenses?/artistic-{v}"),
    License("artistic", "artistic", (r"perl artistic license", r"artistic license"), (r"perlfoundation\.org/artistic",)),
    *_creative_commons(),
    License("cc0-1.0", "cc0-1.0", (r"\bcc0(?:[\s-]1\.0)?\b", r"creative commons (?:cc0|zero)"), (r"creativecommons\.org/publicdomain/zero/1\.0",), (r"has waived all copyright and related or neighboring rights",)),
    License("cc-pdm", "cc-pdm-1.0", (r"public domain mark",), (r"creativecommons\.org/publicdomain/mark",)),
    License("unlicense", "unlicense", (r"the unlicense",), (r"unlicense\.org",), (r"this is free and unencumbered software released into the public domain",)),
    License("public-domain", "licenseref-public-domain", (r"(?:dedicated|released|placed) (?:in)?to the public domain", r"in the public domain", r"public domain dedication")),
    License("wtfpl", "wtfpl", (r"\bwtfpl\b", r"do what the f\w{1,6} you want to public license"), (r"wtfpl\.net",)),
    License("zlib", "zlib", (r"zlib license", r"zlib/libpng license"), (r"zlib\.net/zlib_license",), (r"this software is provided as-is without any express or implied",)),
    License("libpng", "libpng libpng-2.0", (r"libpng license", r"png reference library license")),
    License("bsl-1.0", "bsl-1.0", (r"boost software license",), (r"boost\.org/license_1_0",)),
    License("busl-1.1", "busl-1.1", (r"business source license",), (r"mariadb\.com/bsl11",)),
    License("sspl-1.0", "sspl-1.0", (r"server side public license", r"\bsspl\b"), (r"mongodb\.com/licensing/server-side-public-license",)),
    License("elastic-2.0", "elastic-2.0", (r"elastic license 2\.0", r"elastic license"), (r"elastic\.co/licensing/elastic-license",)),
    License("commons-clause", "licenseref-commons-clause", (r"commons clause",), (r"commonsclause\.com",)),
    License("polyform", "polyform-noncommercial-1.0.0 polyform-small-business-1.0.0", (r"polyform (?:noncommercial|small business|strict|shield|perimeter) license",), (r"polyformproject\.org/licenses",)),
    License("python-2.0", "psf-2.0 python-2.0", (r"python software foundation license", r"psf license"), (r"python\.org/psf/license",)),
    License("php-3.01", "php-3.0 php-3.01", (r"php license",), (r"php\.net/license/3",)),
    License("ruby", "ruby", (r"ruby license", r"same terms as ruby"), (r"ruby-lang\.org/en/about/license",)),
    License("perl", "licenseref-perl", (r"same terms as perl(?: itself)?",)),
    License("postgresql", "postgresql", (r"postgresql licen[cs]e",), (r"postgresql\.org/about/licen[cs]e",)),
    License("openssl", "openssl", (r"openssl license", r"original ssleay license"), (r"openssl\.org/source/license",)),
    License("ncsa", "ncsa", (r"ncsa open source license", r"university of illinois/ncsa"), (r"opensource\.org/licenses?/ncsa",)),
    License("ofl-1.1", "ofl-1.1 ofl-1.0", (r"sil open font license", r"open font license"), (r"scripts\.sil\.org/ofl", r"openfontlicense\.org")),
    License("ubuntu-font-1.0", "ubuntu-font-1.0", (r"ubuntu font licen[cs]e",)),
    License("odbl-1.0", "odbl-1.0", (r"open database license", r"\bodbl\b"), (r"opendatacommons\.org/licenses/odbl",)),
    License("odc-by-1.0", "odc-by-1.0", (r"open data commons attribution", r"\bodc-by\b"), (r"opendatacommons\.org/licenses/by\b",)),
    License("pddl-1.0", "pddl-1.0", (r"public domain dedication and licen[cs]e", r"\bpddl\b"), (r"opendatacommons\.org/licenses/pddl",)),
    License("cdla-permissive", "cdla-permissive-1.0 cdla-permissive-2.0", (r"community data license agreement permissive", r"cdla-permissive"), (r"cdla\.(?:dev|io)/permissive",)),
    License("cdla-sharing", "cdla-sharing-1.0", (r"community data license agreement sharing", r"cdla-sharing"), (r"cdla\.(?:dev|io)/sharing",)),
    License("ms-pl", "ms-pl", (r"microsoft public license",), (r"opensource\.org/licenses?/ms-pl",)),
    License("ms-rl", "ms-rl", (r"microsoft reciprocal license",), (r"opensource\.org/licenses?/ms-rl",)),
    License("w3c", "w3c w3c-19980720 w3c-20150513", (r"w3c software (?:notice|and document) (?:and )?license", r"w3c software license"), (r"w3\.org/consortium/legal/copyright-software",)),
    License("unicode", "unicode-dfs-2016 unicode-3.0", (r"unicode license", r"unicode terms of use"), (r"unicode\.org/(?:license|copyright)",)),
    License("icu", "icu", (r"icu license",)),
    License("curl", "curl", (r"curl license",), (r"curl\.(?:se|haxx\.se)/docs/copyright",)),
    License("ijg", "ijg", (r"independent jpeg group license",), (), (r"this software is based in part on the work of the independent jpeg group",)),
    License("ftl", "ftl", (r"freetype (?:project )?license",), (r"freetype\.org/license",)),
    License("imagemagick", "imagemagick", (r"imagemagick license",), (r"imagemagick\.org/script/license",)),
    License("naist", "naist-2003", (r"naist license", r"nara institute of science and technology license")),
    License("vim", "vim", (r"vim license",)),
    License("latex", "lppl-1.3c lppl-1.3a lppl-1.2", (r"latex project public license", r"\blppl\b"), (r"latex-project\.org/lppl",)),
    License("qpl-1.0", "qpl-1.0", (r"q public license",)),
    License("sleepycat", "sleepycat", (r"sleepycat license",)),
    License("upl-1.0", "upl-1.0", (r"universal permissive license",), (r"oss\.oracle\.com/licenses/upl",)),
    License("blueoak-1.0.0", "blueoak-1.0.0", (r"blue oak model license",), (r"blueoakcouncil\.org/license",)),
    License("mulanpsl-2.0", "mulanpsl-2.0 mulanpsl-1.0", (r"mulan permissive software license", r"mulan psl"), (r"license\.coscl\.org\.cn/mulanpsl",)),
    License("ecl-2.0", "ecl-2.0", (r"educational community license",)),
    License("cecill", "cecill-2.1 cecill-2.0 cecill-b cecill-c", (r"cecill(?:-[bc])? (?:free software )?licen[cs]e",), (r"cecill\.info",)),
    License("llama", "licenseref-llama", (r"llama \d(?:\.\d)? community license",)),
    License("openrail", "licenseref-openrail", (r"\b(?:creativeml )?open ?rail(?:-m|\+\+)?\b",)),
    License("all-rights-reserved", "licenseref-all-rights-reserved", (r"all rights reserved",)),
    License("proprietary", "licenseref-proprietary", (r"proprietary and confidential", r"confidential and proprietary", r"proprietary license"), (), (r"unauthorized (?:copying|use|distribution) (?:of this file )?.{0,60}is strictly prohibited",)),
    License("other-open", "licenseref-other-open", (r"open source license", r"free software license", r"open government licen[cs]e")),
)

#: Words that introduce a license's name.
INTRO = r"(?:licen[cs]ed|released|distributed|available|published|provided|redistributed|covered) (?:\w++ ){0,3}?(?:under|by|with)(?: (?:the|an?|terms|of|conditions|following))* "
PRIORITY = {"tag": (100, 1.0), "notice": (80, 0.95), "intro": (70, 0.95), "url": (60, 0.9), "name": (40, 0.7)}


def _keyword(pattern: str) -> str:
    """The longest run of plain letters, digits and blanks that every match must hold: runs outside groups, classes and
    optional parts."""
    flat, depth, i = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            flat += pattern[i + 1] if not pattern[i + 1].isalnum() and not depth else "\0"
            i += 2
            continue
        if c == "[" and (end := pattern.find("]", i + 1)) > 0:
            flat += "\0"
            i = end + 1
            continue
        depth += (c == "(") - (c == ")")
        if c in "?*{":
            flat = flat[:-1] + "\0"
        if c == "{":
            i = pattern.index("}", i)
        flat += c if not depth and c not in "()?*+.|^${}" else "\0"
        i += 1
    return max(re.split("\0+", flat), key=len).strip()


def build() -> tuple[Rule, ...]:
    """All rules, most important first; those of one importance in the order of the licenses."""
    out: list[Rule] = []

    def add(lic: License, kind: str, pattern: str, keyword: str = "") -> None:
        word = keyword or _keyword(pattern)
        if len(word) < 2:
            raise ValueError(f"no keyword in {pattern}")
        priority, confidence = PRIORITY[kind]
        pattern = spaced(pattern, GAP if kind == "notice" else SPACE)
        out.append(Rule(f"{lic.label}/{kind}/{sum(r.label == lic.label for r in out)}", lic.label, word, re.compile(pattern.encode()), priority, confidence))

    for lic in LICENSES:
        ids = "|".join(re.escape(x) for x in sorted(lic.ids.split(), key=len, reverse=True))
        add(lic, "tag", rf"spdx-license-identifier:\s{{0,4}}\(?(?:{ids})(?![\w.+-])", "spdx-license-identifier")
        for p in lic.notices:
            add(lic, "notice", p)
        for p in lic.urls:
            add(lic, "url", p)
        for p in lic.names:
            add(lic, "intro", INTRO + p, _keyword(p))
            add(lic, "name", p)
    return tuple(sorted(out, key=lambda r: -r.priority))
