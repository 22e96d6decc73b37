"""License scans: ordered signature rules behind a keyword prefilter, with overlaps resolved by priority and containment."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, fresh

#: label, SPDX identifier, how the name is written (a pattern over lower-cased text), keywords of which every name holds one,
#: versions. In patterns a blank stands for any run of white space or hyphens; in keywords such runs are one hyphen. Fixed values.
FAMILIES = (
    ("mit", "mit", r"(?:mit|expat)", "mit expat", ""), ("mit-0", "mit-0", r"mit no attribution", "attribution", ""),
    ("apache", "apache", r"apache(?: software)?", "apache", "1.0 1.1 2.0"), ("gpl", "gpl", r"gnu (?:general public|gpl)", "gnu", "1.0 2.0 3.0"),
    ("lgpl", "lgpl", r"gnu (?:lesser|library) general public", "gnu", "2.0 2.1 3.0"), ("agpl", "agpl", r"gnu affero general public", "affero", "1.0 3.0"),
    ("gfdl", "gfdl", r"gnu free documentation", "gnu", "1.1 1.2 1.3"), ("bsd", "bsd", r"(?:bsd|berkeley software distribution)", "bsd berkeley-software-distribution", "1-clause 2-clause 3-clause 4-clause"),
    ("0bsd", "0bsd", r"(?:zero[- ]clause|0-clause) bsd", "bsd", ""), ("isc", "isc", r"(?:isc|internet systems consortium)", "isc internet-systems-consortium", ""),
    ("mpl", "mpl", r"mozilla public", "mozilla", "1.0 1.1 2.0"), ("epl", "epl", r"eclipse public", "eclipse", "1.0 2.0"),
    ("edl", "edl", r"eclipse distribution", "eclipse", "1.0"), ("cddl", "cddl", r"common development and distribution", "distribution", "1.0 1.1"),
    ("cpl", "cpl", r"common public", "common", "1.0"), ("cc0", "cc0", r"(?:cc0|creative commons zero)", "cc0 creative-commons-zero", "1.0"),
    ("cc-by", "cc-by", r"creative commons attribution", "creative", "1.0 2.0 2.5 3.0 4.0"), ("cc-by-sa", "cc-by-sa", r"creative commons attribution[- ]share ?alike", "creative", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc-sa", "cc-by-nc-sa", r"creative commons attribution[- ]non ?commercial[- ]share ?alike", "creative", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc-nd", "cc-by-nc-nd", r"creative commons attribution[- ]non ?commercial[- ]no ?deriv\w*", "creative", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc", "cc-by-nc", r"creative commons attribution[- ]non ?commercial", "creative", "1.0 2.0 2.5 3.0 4.0"), ("cc-by-nd", "cc-by-nd", r"creative commons attribution[- ]no ?deriv\w*", "creative", "1.0 2.0 2.5 3.0 4.0"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", "unlicense", ""), ("wtfpl", "wtfpl", r"do what the f\w+ you want to public", "public", "2.0"),
    ("zlib", "zlib", r"zlib(?:/libpng)?", "zlib", ""), ("libpng", "libpng", r"libpng", "libpng", "2.0"),
    ("bsl", "bsl", r"boost software", "boost", "1.0"), ("artistic", "artistic", r"(?:perl )?artistic", "artistic", "1.0 2.0"),
    ("python", "psf", r"python(?: software foundation)?", "python", "2.0"), ("ruby", "ruby", r"ruby", "ruby", ""),
    ("php", "php", r"php", "php", "3.0 3.01"), ("perl", "perl", r"same terms as perl", "perl", ""),
    ("openssl", "openssl", r"openssl", "openssl", ""), ("ssleay", "ssleay", r"original ssleay", "ssleay", ""),
    ("postgresql", "postgresql", r"postgresql", "postgresql", ""), ("eupl", "eupl", r"european union public", "european", "1.0 1.1 1.2"),
    ("cecill", "cecill", r"cecill", "cecill", "1.0 2.0 2.1"), ("ms-pl", "ms-pl", r"microsoft public", "microsoft", ""),
    ("ms-rl", "ms-rl", r"microsoft reciprocal", "microsoft", ""), ("ofl", "ofl", r"(?:sil )?open font", "font", "1.0 1.1"),
    ("osl", "osl", r"open software", "open", "1.0 2.0 2.1 3.0"), ("afl", "afl", r"academic free", "academic", "1.1 1.2 2.0 2.1 3.0"),
    ("upl", "upl", r"universal permissive", "permissive", "1.0"), ("ncsa", "ncsa", r"university of illinois(?:/| )ncsa", "ncsa", ""),
    ("x11", "x11", r"x11", "x11", ""), ("curl", "curl", r"curl", "curl", ""),
    ("json", "json", r"json", "json", ""), ("odbl", "odbl", r"open (?:data )?database", "database", "1.0"),
    ("odc-by", "odc-by", r"open data commons attribution", "commons", "1.0"), ("pddl", "pddl", r"public domain dedication and", "domain", "1.0"),
    ("rpl", "rpl", r"reciprocal public", "reciprocal", "1.1 1.5"), ("sspl", "sspl", r"server side public", "server", "1.0"),
    ("busl", "busl", r"business source", "business", "1.1"), ("elastic", "elastic", r"elastic", "elastic", "2.0"),
    ("apsl", "apsl", r"apple public source", "apple", "1.0 1.1 1.2 2.0"), ("ipl", "ipl", r"ibm public", "ibm", "1.0"),
    ("lppl", "lppl", r"latex project public", "latex", "1.0 1.1 1.2 1.3c"), ("qpl", "qpl", r"q public", "public", "1.0"),
    ("sleepycat", "sleepycat", r"sleepycat", "sleepycat", ""), ("vim", "vim", r"vim", "vim", ""),
    ("w3c", "w3c", r"w3c(?: software)?", "w3c", ""), ("zpl", "zpl", r"zope public", "zope", "1.1 2.0 2.1"),
    ("mulanpsl", "mulanpsl", r"mulan (?:permissive software|psl)", "mulan", "1.0 2.0"), ("blueoak", "blueoak", r"blue oak model", "oak", "1.0.0"),
    ("hippocratic", "hippocratic", r"hippocratic", "hippocratic", "2.1"), ("llama", "llama", r"llama (?:2|3|community)", "llama", ""),
)
#: Sentences of licenses and notices, each a signature of its own: label, pattern. Fixed values.
GRANTS = tuple(tuple(line.split(" | ", 1)) for line in r"""
mit | permission is hereby granted, free of charge, to any person obtaining a copy
mit | the above copyright notice and this permission notice shall be included in all copies
mit | to deal in the software without restriction, including without limitation the rights
mit | sublicense, and(?:/or)? sell copies of the software
mit-0 | permission is hereby granted, free of charge, to any person obtaining a copy of this software .{0,60}without restriction, .{0,40}no attribution
isc | permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee
isc | provided that the above copyright notice and this permission notice appear in all copies
0bsd | permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted\.
bsd | redistribution and use in source and binary forms,? with or without modification
bsd | redistributions of source code must retain the above copyright notice
bsd | redistributions in binary form must reproduce the above copyright notice
bsd | neither the name of [\s\S]{1,80}? nor the names of its contributors
bsd-4-clause | all advertising materials mentioning features or use of this software must display
bsd | this software is provided by the (?:copyright holders and contributors|regents and contributors|author) .as is.
bsd-3-clause-clear | no express or implied licenses to any party's patent rights are granted
zlib | this software is provided 'as-is', without any express or implied warranty
zlib | the origin of this software must not be misrepresented
zlib | altered source versions must be plainly marked as such
libpng | this copy of the libpng notices is provided for your convenience
unlicense | free and unencumbered software released into the public domain
unlicense | anyone is free to copy, modify, publish, use, compile, sell, or distribute this software
public-domain | (?:placed|released|dedicated) (?:in|into|to) the public domain
public-domain | (?:is|are) in the public domain
public-domain | no copyright is claimed
public-domain | the author disclaims copyright to this source code
apache | licensed to the apache software foundation \(asf\) under one or more contributor
apache | you may not use this file except in compliance with the license
apache | unless required by applicable law or agreed to in writing, software distributed under the license
apache | terms and conditions for use, reproduction, and distribution
apache | grants to you a perpetual, worldwide, non exclusive, no charge, royalty free, irrevocable copyright license
apache-1.1 | this product includes software developed by the apache
gpl | under the terms of the gnu general public license as published by the free software foundation
gpl | it under the terms of the gnu general public license
gpl | either version \d of the license, or \(at your option\) any later version
gpl | you should have received a copy of the gnu general public license
gpl | the licenses for most software are designed to take away your freedom
gpl | everyone is permitted to copy and distribute verbatim copies of this license document
gpl | this general public license does not permit incorporating your program into proprietary programs
gpl-3.0 | the gnu general public license is a free, copyleft license for software
gpl-2.0 | activities other than copying, distribution and modification are not covered by this license
gpl-classpath | as a special exception, the copyright holders of this library give you permission to link
gpl-autoconf | as a special exception to the gnu general public license, if you distribute this file as part of a program
lgpl | under the terms of the gnu (?:lesser|library) general public license as published
lgpl | you should have received a copy of the gnu (?:lesser|library) general public license
lgpl | this library is free software; you can redistribute it
lgpl | a program that contains no derivative of any portion of the library
agpl | under the terms of the gnu affero general public license
agpl | you should have received a copy of the gnu affero general public license
agpl | users interacting with it remotely through a computer network
gfdl | permission is granted to copy, distribute and(?:/or)? modify this document under the terms of the gnu free documentation
gfdl | with no invariant sections, no front cover texts,? and no back cover texts
mpl | this source code form is subject to the terms of the mozilla public license
mpl | if a copy of the mpl was not distributed with this file
mpl | the contents of this file are subject to the mozilla public license
mpl-1.1 | alternatively, the contents of this file may be used under the terms of either the gnu general public license
epl | this program and the accompanying materials are made available under the terms of the eclipse public license
epl | any use, reproduction or distribution of the program constitutes recipient's acceptance of this agreement
edl | made available under the terms of the eclipse distribution license
cddl | the contents of this file are subject to the terms of the common development and distribution license
cddl | you can obtain a copy of the license at usr/src/opensolaris\.license
cpl | made available under the terms of the common public license
cc0 | the person who associated a work with this deed has dedicated the work to the public domain
cc0 | to the extent possible under law,? .{1,80}has waived all copyright
cc-by | this work is licensed under a creative commons attribution \d
cc-by | you must give appropriate credit, provide a link to the license,? and indicate if changes were made
cc-by-sa | you must distribute your contributions under the same license as the original
cc-by-nc | you may not use the material for commercial purposes
cc-by-nd | if you remix, transform, or build upon the material, you may not distribute the modified material
bsl | permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation
bsl | distributed under the boost software license
artistic | the intent of this document is to state the conditions under which a package may be copied
artistic | everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed
artistic | this is free software; you can redistribute it and(?:/or)? modify it under the same terms as perl
perl | under the same terms as (?:the )?perl (?:5 )?(?:programming language )?(?:system )?itself
python | psf is making python available to licensee on an .as is. basis
python | this license agreement is between the python software foundation
python | permission to use, copy, modify, and distribute this software and its documentation for any purpose and without fee is hereby granted
ruby | you may redistribute it and(?:/or)? modify it under either the terms of the 2 clause bsdl
php | this product includes php software, freely available from
openssl | this product includes software developed by the openssl project
ssleay | this product includes cryptographic software written by eric young
postgresql | without a written agreement is hereby granted, provided that the above copyright notice and this paragraph
postgresql | in no event shall the university of california be liable to any party
eupl | licensed under the eupl
eupl | the work is provided under the terms of this licence
cecill | this software is governed by the cecill
cecill | ce logiciel est r.gi par la licence cecill
ms-pl | this license governs use of the accompanying software\. if you use the software, you accept this license
ms-rl | for any file you distribute that contains code from the software \(in source code or binary format\)
ofl | this font software is licensed under the sil open font license
ofl | neither the font software nor any of its individual components
osl | licensed under the open software license
afl | licensed under the academic free license
upl | the universal permissive license \(upl\)
upl | subject to the condition set forth below, permission is hereby granted to any person obtaining a copy of this software
ncsa | permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files \(the .software.\), to deal with the software
x11 | except as contained in this notice, the name of [\s\S]{1,80}? shall not be used in advertising
curl | the name of a copyright holder shall not be used in advertising or otherwise to promote the sale
json | the software shall be used for good, not evil
odbl | this database is made available under the open database license
odc-by | made available under the open data commons attribution license
pddl | made available under the public domain dedication and license
rpl | unless explicitly acquired and licensed from licensor under another license
sspl | if you make the functionality of the program or a modified version available to third parties as a service
busl | the licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non production use
elastic | you may not provide the software to third parties as a hosted or managed service
apsl | this file contains original code and(?:/or)? modifications of original code as defined in and that are subject to the apple public source license
ipl | the accompanying program is provided under the terms of this ibm public license
lppl | this work may be distributed and(?:/or)? modified under the conditions of the latex project public license
qpl | this file may be distributed under the terms of the q public license
sleepycat | redistributions in any form must be accompanied by information on how to obtain complete source code
vim | there are no restrictions on distributing unmodified copies of vim
w3c | by obtaining(?: and/or copying|, using and/or copying) this work, you \(the licensee\) agree
zpl | this software is subject to the provisions of the zope public license
mulanpsl | you can use this software according to the terms and conditions of the mulan psl
blueoak | this license gives everyone as much permission to work with this software as possible
hippocratic | the software may not be used by individuals, corporations, governments, or other groups for systems or activities that actively and knowingly endanger
llama | llama materials means, collectively
llama | built with (?:meta )?llama
openrail | use based restrictions as referenced in paragraph
openrail | open rail(?:-?m)? license
wtfpl | everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed
wtfpl | you just do what the f\w+ you want to
beerware | you can do whatever you want with this stuff\. if we meet some day
beerware | buy me a beer in return
isc | the software is provided .as is. and the author disclaims all warranties
hpnd | without fee, provided that the above copyright notice appears? in all copies and that both that copyright notice
ntp | provided that the above copyright notice appears in all copies and that both the copyright notice and this permission notice appear
unicode | unicode, inc\. license agreement
unicode | permission is hereby granted, free of charge, to any person obtaining a copy of the unicode data files
icu | icu license
ijg | this software is based in part on the work of the independent jpeg group
freetype | portions of this software are copyright .{1,60}the freetype project
fsfap | copying and distribution of this file, with or without modification, are permitted in any medium without royalty
fsful | this file is free software; the free software foundation gives unlimited permission to copy
fair | usage of the works is permitted provided that this instrument is retained with the works
naist | nara institute of science and technology
oldap | the openldap public license
spl | sun public notice
sissl | sun industry standards source license
watcom | sybase open watcom public license
xnet | this agreement shall be governed in all respects by the laws of the state of california and by the laws of the united states of america
zend | this product includes the zend engine
ogl | contains public sector information licensed under the open government licen[cs]e
etalab | licence ouverte / open licence
dl-de | datenlizenz deutschland
cc-public-domain | public domain mark
gutenberg | this ebook is for the use of anyone anywhere (?:in the united states and most other parts of the world )?at no cost
gutenberg | project gutenberg(?:-?tm)? license
wikipedia | text is available under the creative commons attribution share ?alike license
stackexchange | user contributions licensed under cc by sa
arxiv | arxiv\.org perpetual, non exclusive license
creative-commons | some rights reserved
copyleft | copyleft license
proprietary | all rights reserved
proprietary | proprietary and confidential
proprietary | unauthorized copying of this (?:file|document)
proprietary | no part of this (?:publication|book|work|document) may be reproduced
proprietary | may not be reproduced, distributed, or transmitted in any form
proprietary | for internal use only
proprietary | trade secrets? of
proprietary | without the (?:prior|express) written (?:permission|consent) of
proprietary | end user license agreement
proprietary | this software is licensed, not sold
proprietary | you may not reverse engineer, decompile, or disassemble
proprietary | use, duplication,? or disclosure by the (?:u\.s\. )?government is subject to restrictions
non-commercial | for non ?commercial use only
non-commercial | not for commercial use
non-commercial | for academic (?:and|or) research use only
evaluation | for evaluation purposes only
""".strip().split("\n"))
#: Identifiers that are common words: with a number they name a license only as written there.
WORDS = {"apache", "artistic", "elastic", "hippocratic", "php"}
#: Labels of notices that forbid or reserve without naming a license.
VAGUE = {"proprietary", "non-commercial", "evaluation", "creative-commons", "copyleft"}
BASE = (("mit", ("mit", "license")), ("apache", ("apache", "license")), ("gpl", ("general", "public", "license")))
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_IN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
_WORD = re.compile(WORD)
_GAPS = re.compile(r"[\s-]+")
_BASE = tuple((label, re.compile(rf"(?<!{_IN_WORD}){_GAP.join(p)}(?!{_IN_WORD})")) for label, p in BASE)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    label: str
    #: Each match holds one of them, with runs of white space and hyphens as one hyphen.
    keywords: tuple[str, ...]
    pattern: re.Pattern
    #: Lower goes first; the earlier rule wins between equals.
    priority: int
    confidence: float


def keyword(pattern: str) -> str:
    """The longest text that every match of a pattern without nested groups holds, with runs of blanks as one hyphen."""
    parts = re.split(r"\(\?:[^)]*\)\??|\[[^\]]*\](?:[*+?]|\{[^}]*\}\??)?|\\w[+*]?|\\d|\\s|\\|\.\{[^}]*\}|.\?|[.()'-]", pattern)
    return max(parts, key=len).strip().replace(" ", "-")


def _loose(pattern: str) -> str:
    """pattern, where each blank takes any run of white space or hyphens."""
    return re.sub(r"(?:\[- \]| )(\?)?", lambda m: r"[\s-]*" if m[1] else r"[\s-]+", pattern)


@cache
def rules() -> tuple[Rule, ...]:
    """Some six hundred ordered signatures: tags and addresses, then grants with and without a version, then mentions."""
    out = []
    add = lambda label, keys, pattern, priority, sure: out.append(Rule(label, tuple(keys.split()), re.compile(_loose(pattern)), priority, sure))
    for label, pattern in GRANTS:
        add(label, keyword(pattern), pattern, 3 if label in VAGUE else 2, 0.5 if label in VAGUE else 0.9)
    for label, spdx, name, keys, versions in FAMILIES:
        # An identifier that goes on to be another one's (cc-by, cc-by-nc) is not this one.
        more = "|".join(f[1][len(spdx) + 1 :].replace("-", " ") for f in FAMILIES if f[1].startswith(f"{spdx}-"))
        more = rf"(?!{'-' if more.isdigit() else ' '}(?:{more})\b)" if more else ""
        part, short = re.escape(spdx) + more, spdx.replace("-", " ") + more
        either, any_key = f"(?:{name}|{short})", f"{keys} {spdx}"
        add(label, "spdx-license-identifier", rf"spdx-license-identifier:\s*\(?{part}(?:-[\w.]+)*\b", 0, 1.0)
        add(label, "licenses/", rf"(?:opensource\.org|spdx\.org|gnu\.org|apache\.org|choosealicense\.com|creativecommons\.org)/licenses/{part}\b[\w.\-/]*", 0, 0.95)
        license_ = rf"{name}(?: public)?(?: license)?"
        for v in versions.split():
            number = re.escape(v.removesuffix(".0"))
            add(label, keys, rf"\b{license_},? (?:\(?version|v\.?|ver\.?)? ?{number}(?:\.0)?\b", 1, 0.95)
            if spdx in WORDS:
                add(f"{label}-{v}", spdx, rf"\b{short} v?{re.escape(v)}\b", 3, 0.8)
            elif v.endswith("clause"):
                add(f"{label}-{v}", spdx, rf"\b{short} {v.replace('-', ' ')}\b", 3, 0.8)
            else:
                add(f"{label}-{v}", spdx, rf"\b{short},? ?(?:version|ver\.?|v\.?)? ?{number}{r'(?:\.0)?' if v.endswith('.0') else ''}(?!\w|\.\d)", 3, 0.8)
        add(label, any_key, rf"\b(?:licensed|released|distributed|available|provided|published) under (?:the )?(?:terms of )?(?:the )?{either}(?: ?v?\d+(?:\.\d+)*)?\b(?: license)?", 1, 0.9)
        add(label, any_key, rf"\b{either}(?: ?v?\d+(?:\.\d+)*)? licen[cs]e\b", 4, 0.7)
        add(label, "license:", rf"\blicense: ?['\"]?{short}(?: ?v?\d+(?:\.\d+)*)?\b", 2, 0.85)
        if spdx.startswith("cc-by"):
            add(label, spdx, rf"\b{part if spdx == 'cc-by' else short}\b", 4, 0.7)
    return tuple(out)


@cache
def _prefilter() -> ahocorasick.Automaton:
    by_key: dict[str, list[int]] = {}
    for i, r in enumerate(rules()):
        for key in r.keywords:
            by_key.setdefault(key, []).append(i)
    found = ahocorasick.Automaton()
    for key, own in by_key.items():
        found.add_word(key, tuple(own))
    found.make_automaton()
    return found


def detections(text: str) -> list[tuple[int, int, Rule]]:
    """What the rules find in a lower-cased text, by start, after suppression. Only rules with a keyword that occurs are tried."""
    wanted: set[int] = set()
    for _, own in _prefilter().iter(_GAPS.sub("-", text)):
        wanted.update(own)
    return resolved(text, wanted) if wanted else []


def resolved(text: str, wanted: Iterable[int]) -> list[tuple[int, int, Rule]]:
    """What the wanted rules find in a lower-cased text, by start.

    In the order of priority, then length, then rule, a detection stays unless an earlier one contains its interval.
    """
    every = rules()
    hits = [(m.start(), m.end(), i) for i in sorted(wanted) for m in every[i].pattern.finditer(text)]
    hits.sort(key=lambda h: (every[h[2]].priority, h[0] - h[1], h[2], h[0]))
    kept: list[tuple[int, int, int]] = []
    starts: list[int] = []  # of the kept intervals that no other contains; their ends ascend too
    ends: list[int] = []
    for s, e, i in hits:
        at = bisect_right(starts, s)
        if at and ends[at - 1] >= e:
            continue
        kept.append((s, e, i))
        low = bisect_left(starts, s)
        high = max(low, bisect_right(ends, e))
        starts[low:high], ends[low:high] = [s], [e]
    return [(s, e, every[i]) for s, e, i in sorted(kept)]


def scan(text: str | None) -> tuple:
    """(n_words, n_base, first_word, last_word, base labels, all labels, score, spans) of one text."""
    low = (text or "").translate(_LOWER) if text and not text.isascii() else (text or "").lower()
    n_words = len(_WORD.findall(low))
    places: list[int] = []
    base: set[str] = set()
    if "license" in low:
        for label, pattern in _BASE:
            for m in pattern.finditer(low):
                places.append(m.start())
                base.add(label)
    found = detections(low)
    labels = base | {r.label for _, _, r in found}
    miss = 1.0
    for _, _, r in found:
        miss *= 1 - r.confidence
    first = last = None
    if places:
        first, last = (len(_WORD.findall(low[:p])) for p in (min(places), max(places)))
    spans = [{"start": s, "end": e, "label": r.label, "confidence": r.confidence} for s, e, r in found]
    return n_words, len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), max(1 - miss, 0.7 if base else 0.0), spans


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start:long,end:long,label:string,confidence:double>>"
_NAMES = [x.split()[0] for x in SCHEMA.split(" spans")[0].rstrip(",").split(", ")] + ["spans"]


def scan_licenses(docs: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The kept columns (all by default) and what `scan` gives for each row's whole text, by rows, without a shuffle.

    spans are character intervals of the text. Null texts are empty: no words, no labels, score 0. Repeated rows give
    equal rows; extra columns stay, and names that clash with the added ones keep to the row's own, which get leading
    underscores. An empty table gives no rows.
    """
    keep = tuple(docs.columns) if keep is None else keep
    names = fresh(docs.select(*keep), *_NAMES)
    body = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("body"))
    kinds = [docs.schema[c].dataType.simpleString() for c in keep]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("confidence", pa.float64())]))
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(t) for t in batch.column("body").to_pylist()]
            got = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(f"k{i}") for i in range(len(keep))] + got, [f"k{i}" for i in range(len(keep))] + _NAMES)

    out = body.mapInArrow(kernel, ", ".join(f"k{i} {t}" for i, t in enumerate(kinds)) + (", " if keep else "") + SCHEMA)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[F.col(a).alias(b) for a, b in zip(_NAMES, names, strict=True)])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_licenses(docs, keep=("doc_id",)).drop("spans")
