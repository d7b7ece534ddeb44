"""License scans: ordered signature rules behind a keyword prefilter.

A text is cut into words (digits, letters, everything beyond ASCII); rules are
regexes over the words joined by single spaces. A document is scanned only if
it holds a keyword of any rule, and a rule only if it holds the rule's own.
Detections that lie within a longer one, or share its interval and come later
in the order of rules, are suppressed. DataFrame functions only.

Cases: null and empty texts have no words and no detections. Repeated rows are
scanned each on their own. Null ids are kept. An empty table gives an empty
result. Base phrases are always kept and suppress nothing. Other columns are ignored.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import texts

SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Base phrases and labels. Fixed values.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


@dataclass(frozen=True)
class Signature:
    """``pattern`` is matched on whole words, case-insensitively; ``keyword`` must occur first; weight in (0, 1]."""

    label: str
    keyword: str
    pattern: str
    weight: float
    base: bool = False


#: Rules written out for sentences of license texts and notices: label, keyword, pattern, weight.
WRITTEN = (
    # MIT and its kin
    ("mit", "to deal in the software", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell", 1.0),
    ("mit", "above copyright notice and this permission", r"the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions", 1.0),
    ("mit", "in no event shall the authors", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability", 0.9),
    ("mit", "terms of the mit", r"(?:under|by|with) the terms of the mit licen[cs]e", 0.95),
    ("mit", "mit style", r"mit style licen[cs]e", 0.8),
    ("mit", "mit or apache", r"mit or apache 2 0", 0.9),
    ("mit-0", "mit no attribution", r"mit no attribution(?: licen[cs]e)?", 0.95),
    ("mit-0", "mit 0", r"mit 0 licen[cs]e", 0.9),
    ("x11", "x11 licen", r"x11 licen[cs]e", 0.9),
    ("x11", "except as contained in this notice", r"except as contained in this notice the names? of (?:[^ ]+ ){1,8}?shall not be used in advertising", 1.0),
    ("expat", "expat licen", r"expat licen[cs]e", 0.9),
    ("json", "shall be used for good", r"the software shall be used for good not evil", 1.0),
    ("ncsa", "university of illinois", r"university of illinois (?:ncsa )?(?:open source )?licen[cs]e", 0.95),
    # ISC, HPND, and short permissive grants
    ("isc", "author disclaims all warranties", r"the author disclaims all warranties with regard to this software", 0.9),
    ("0bsd", "zero clause bsd", r"zero clause bsd(?: licen[cs]e)?", 0.95),
    ("0bsd", "0bsd", r"0bsd", 0.9),
    ("hpnd", "historical permission notice", r"historical permission notice and disclaimer", 0.95),
    ("hpnd", "without fee is hereby granted", r"permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted", 0.95),
    ("curl", "curl licen", r"curl licen[cs]e", 0.9),
    ("ntp", "ntp licen", r"ntp licen[cs]e", 0.9),
    ("postgresql", "postgresql licen", r"postgresql licen[cs]e", 0.95),
    ("postgresql", "without a written agreement", r"without a written agreement is hereby granted provided that the above copyright notice", 0.95),
    ("beerware", "beerware", r"(?:the )?beerware licen[cs]e", 0.95),
    ("beerware", "buy me a beer", r"you can buy me a beer in return", 0.95),
    ("wtfpl", "do what the fuck", r"do what the fuck you want to(?: public licen[cs]e)?", 1.0),
    ("fair", "usage of the works is permitted", r"usage of the works is permitted provided that this instrument is retained", 1.0),
    ("fsfap", "copying and distribution of this file", r"copying and distribution of this file with or without modification are permitted in any medium without royalty", 1.0),
    ("fsful", "unlimited permission to copy", r"gives unlimited permission to copy and or distribute it", 1.0),
    ("blue-oak", "blue oak", r"blue oak model licen[cs]e(?: 1 0 0)?", 0.95),
    ("upl", "universal permissive", r"universal permissive licen[cs]e(?: v(?:ersion)? ?1 0)?", 0.95),
    ("mulan", "mulan", r"mulan (?:psl|permissive software licen[cs]e)(?: v(?:ersion)? ?[12])?", 0.95),
    ("afmparse", "afmparse", r"afmparse licen[cs]e", 0.8),
    ("libpng", "libpng", r"libpng licen[cs]e(?: version 2)?", 0.9),
    ("libpng", "png reference library", r"png reference library licen[cs]e(?: version 2)?", 0.9),
    ("zlib", "origin of this software must not", r"the origin of this software must not be misrepresented", 1.0),
    ("zlib", "altered source versions", r"altered source versions must be plainly marked as such", 1.0),
    ("bzip2", "bzip2", r"bzip2 (?:and libbzip2 )?licen[cs]e", 0.9),
    ("ijg", "independent jpeg group", r"this software is based in part on the work of the independent jpeg group", 1.0),
    ("openssl", "openssl", r"openssl licen[cs]e", 0.9),
    ("openssl", "openssl toolkit", r"developed by the openssl project for use in the openssl toolkit", 1.0),
    ("ssleay", "eric young", r"includes cryptographic software written by eric young", 1.0),
    ("ruby", "ruby licen", r"ruby licen[cs]e", 0.85),
    ("ruby", "ruby s licen", r"ruby s licen[cs]e", 0.85),
    ("tcl", "tcl", r"tcl tk licen[cs]e", 0.85),
    ("unicode", "unicode", r"unicode (?:inc )?licen[cs]e agreement(?: data files and software)?", 0.95),
    ("vim", "vim licen", r"vim licen[cs]e", 0.9),
    ("w3c", "w3c", r"w3c (?:software (?:notice )?(?:and document )?(?:notice )?(?:and )?)licen[cs]e", 0.95),
    ("icu", "icu licen", r"icu licen[cs]e", 0.9),
    ("info-zip", "info zip", r"info zip licen[cs]e", 0.9),
    ("imagemagick", "imagemagick", r"imagemagick licen[cs]e", 0.9),
    ("freetype", "freetype", r"(?:the )?freetype (?:project )?licen[cs]e", 0.95),
    # BSD clauses and notices
    ("bsd", "redistributions of source code", r"redistributions of source code must retain the above copyright notice", 1.0),
    ("bsd", "redistributions in binary form", r"redistributions in binary form must reproduce the above copyright notice", 1.0),
    ("bsd-3-clause", "to endorse or promote", r"may be used to endorse or promote products derived from this software without specific prior written permission", 1.0),
    ("bsd-4-clause", "advertising materials mentioning", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 1.0),
    ("bsd", "regents of the university", r"(?:copyright |by )the regents of the university of california", 0.8),
    ("bsd", "bsd style", r"governed by a bsd style licen[cs]e", 0.95),
    ("bsd", "bsd", r"(?:two|three|four) clause bsd(?: licen[cs]e)?", 0.9),
    ("bsd-3-clause", "bsd", r"(?:revised|new) bsd", 0.75),
    ("bsd-2-clause", "freebsd", r"freebsd (?:documentation )?licen[cs]e", 0.9),
    ("bsd-2-clause-patent", "bsd", r"bsd (?:2 clause )?plus patent(?: licen[cs]e)?", 0.95),
    # Apache and Mozilla
    ("apache-2.0", "apache org licenses", r"(?:http |https )?(?:www )?apache org licenses licen[cs]e 2 0", 1.0),
    ("apache-2.0", "in compliance with the licen", r"you may not use (?:this|these) (?:file|work|software|files) except in compliance with the licen[cs]e", 0.95),
    ("apache-2.0", "licensed to the apache software", r"licensed to the apache software foundation asf under one or more contributor licen[cs]e agreements", 1.0),
    ("apache-1.1", "developed by the apache software", r"this product includes software developed by the apache software foundation", 0.95),
    ("apache-2.0", "as is basis", r"distributed on an as is basis without warranties or conditions of any kind", 0.9),
    ("apache-2.0", "apache 2", r"apache 2(?: 0)?(?: licen[cs]ed?)?", 0.75),
    ("mpl", "subject to the terms of the mozilla", r"this source code form is subject to the terms of the mozilla public licen[cs]e(?: v ?2 0)?", 1.0),
    ("mpl", "contents of this file are subject to the mozilla", r"the contents of this file are subject to the mozilla public licen[cs]e", 1.0),
    ("mpl", "mozilla org", r"mozilla org mpl(?: 2 0)?", 0.9),
    ("npl", "netscape public", r"netscape public licen[cs]e(?: version 1 [01])?", 0.95),
    ("mpl-no-copyleft", "incompatible with secondary", r"incompatible with secondary licenses", 0.9),
    # GNU
    ("gpl", "published by the free software foundation", r"published by the free software foundation", 0.8),
    ("gpl", "you should have received a copy of the gnu", r"you should have received a copy of the gnu (?:lesser |library |affero )?general public licen[cs]e", 1.0),
    ("gpl", "see the gnu", r"see the gnu (?:lesser |library |affero )?general public licen[cs]e for more details", 1.0),
    ("gpl", "everyone is permitted to copy", r"everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document", 1.0),
    ("gpl", "gnu gpl", r"gnu gpl(?: v ?[123])?", 0.85),
    ("lgpl", "gnu lgpl", r"gnu lgpl(?: v ?[23](?: [01])?)?", 0.85),
    ("agpl", "gnu agpl", r"gnu agpl(?: v ?3)?", 0.85),
    ("gpl-classpath", "classpath", r"(?:subject to the )?classpath exception", 0.95),
    ("gpl-linking-exception", "as a special exception", r"as a special exception (?:[^ ]+ ){0,12}?(?:link|permission)", 0.8),
    ("gcc-exception", "gcc runtime", r"gcc runtime library exception", 0.95),
    ("bison-exception", "bison parser skeleton", r"as a special exception you may create a larger work that contains part or all of the bison parser skeleton", 1.0),
    ("autoconf-exception", "autoconf", r"configuration script generated by autoconf", 0.9),
    ("font-exception", "font exception", r"(?:gpl )?font exception", 0.85),
    ("linux-syscall-note", "linux syscall", r"linux syscall note", 0.95),
    ("gpl", "dual licensed", r"dual licensed under (?:the )?(?:gnu )?gpl", 0.9),
    ("gfdl", "invariant sections", r"with no invariant sections", 0.9),
    ("copyleft", "copyleft", r"copyleft(?: licen[cs]es?)?", 0.4),
    # Other reciprocal licenses
    ("epl", "accompanying materials are made available", r"this program and the accompanying materials are made available under the terms of", 0.9),
    ("epl", "eclipse org legal", r"eclipse org legal epl(?: v ?(?:10|20|1 0|2 0))?", 0.95),
    ("edl", "eclipse distribution", r"eclipse distribution licen[cs]e(?: v ?1 0)?", 0.95),
    ("cddl", "cddl", r"cddl(?: v(?:ersion)?)?(?: ?1 [01])?", 0.85),
    ("ipl", "ibm public", r"ibm public licen[cs]e(?: version 1 0)?", 0.95),
    ("ms-pl", "microsoft public", r"microsoft public licen[cs]e(?: ms pl)?", 0.95),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[cs]e(?: ms rl)?", 0.95),
    ("apsl", "apple public source", r"apple public source licen[cs]e(?: version)?(?: [12] [0-2])?", 0.95),
    ("cpal", "common public attribution", r"common public attribution licen[cs]e(?: version)?(?: 1 0)?", 0.95),
    ("cecill", "cecill", r"cecill(?: (?:a|b|c))?(?: free software)?(?: licen[cs]e)?(?: agreement)?", 0.9),
    ("eupl", "eupl", r"eupl(?: v(?:ersion)?)?(?: ?1 [012])?", 0.85),
    ("qpl", "q public", r"q public licen[cs]e", 0.95),
    ("sleepycat", "sleepycat", r"sleepycat (?:software )?(?:public )?licen[cs]e", 0.95),
    ("spl", "sun public", r"sun public licen[cs]e", 0.95),
    ("sissl", "sun industry standards", r"sun industry standards source licen[cs]e", 0.95),
    ("nasa", "nasa open source", r"nasa open source agreement(?: version 1 3)?", 0.95),
    ("lppl", "latex project", r"latex project public licen[cs]e(?: version 1 [0-3][a-c]?)?", 0.95),
    ("lpl", "lucent public", r"lucent public licen[cs]e", 0.95),
    ("rpl", "reciprocal public", r"reciprocal public licen[cs]e(?: 1 [15])?", 0.95),
    ("rpsl", "realnetworks public", r"realnetworks public source licen[cs]e", 0.95),
    ("vsl", "vovida", r"vovida software licen[cs]e", 0.95),
    ("watcom", "sybase open", r"sybase open watcom public licen[cs]e", 0.95),
    ("nokia", "nokia open source", r"nokia open source licen[cs]e", 0.95),
    ("eiffel", "eiffel forum", r"eiffel forum licen[cs]e(?: version 2)?", 0.95),
    ("ecl", "educational community", r"educational community licen[cs]e(?: version)?(?: [12] 0)?", 0.95),
    ("ofl", "reserved font name", r"with reserved font name", 0.9),
    ("ofl", "scripts sil org ofl", r"scripts sil org ofl", 0.95),
    ("parity", "parity public", r"parity public licen[cs]e", 0.95),
    ("cern-ohl", "cern open hardware", r"cern open hardware licen[cs]e(?: version \d(?: \d)?)?(?: (?:strongly reciprocal|weakly reciprocal|permissive))?", 0.95),
    ("tapr", "tapr open hardware", r"tapr open hardware licen[cs]e", 0.95),
    # Content, data and model licenses
    ("cc0", "waived all copyright", r"(?:has )?waived all copyright and related or neighbou?ring rights", 1.0),
    ("cc0", "creativecommons org publicdomain", r"creativecommons org publicdomain zero(?: 1 0)?", 1.0),
    ("cc", "creativecommons org licenses", r"creativecommons org licenses [a-z]+(?: [a-z]+)?(?: [a-z]+)? \d \d", 1.0),
    ("cc", "some rights reserved", r"some rights reserved", 0.6),
    ("cc-sampling", "sampling plus", r"(?:creative commons )?sampling plus(?: 1 0)?", 0.8),
    ("unlicense", "free and unencumbered", r"this is free and unencumbered software released into the public domain", 1.0),
    ("public-domain", "no copyright is claimed", r"no copyright is claimed", 0.8),
    ("public-domain", "a work of the", r"(?:is )?a work of the (?:u s|united states) government", 0.8),
    ("odc-by", "open data commons", r"open data commons attribution licen[cs]e", 0.95),
    ("odbl", "open data commons", r"open data commons open database licen[cs]e", 0.95),
    ("pddl", "open data commons", r"open data commons public domain dedication and licen[cs]e", 0.95),
    ("cdla", "community data", r"community data licen[cs]e agreement(?: (?:permissive|sharing))?(?: version)?(?: [12] 0)?", 0.95),
    ("ogl-uk", "open government licen", r"open government licen[cs]e(?: v ?[123](?: 0)?)?", 0.9),
    ("etalab", "licence ouverte", r"licence ouverte(?: open licence)?", 0.9),
    ("free-art", "free art", r"free art licen[cs]e(?: 1 3)?", 0.9),
    ("openrail", "openrail", r"(?:creativeml |bigscience )?openrail(?: m)?(?: licen[cs]e)?", 0.9),
    ("openrail", "open rail", r"(?:creativeml |bigscience )?open rail(?: m)?(?: licen[cs]e)?", 0.9),
    # Source-available, commercial and reserved
    ("commons-clause", "commons clause", r"commons clause(?: licen[cs]e)?(?: condition)?", 0.95),
    ("elastic", "elastic licen", r"elastic licen[cs]e(?: 2 0)?", 0.95),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|strict|shield|free trial|internal use|perimeter) licen[cs]e(?: 1 0 0)?", 0.95),
    ("prosperity", "prosperity public", r"prosperity public licen[cs]e", 0.95),
    ("non-commercial", "non commercial use", r"(?:for )?non commercial use only", 0.7),
    ("non-commercial", "noncommercial use", r"(?:for )?noncommercial use only", 0.7),
    ("non-commercial", "commercial use", r"not for commercial use", 0.7),
    ("evaluation", "evaluation purposes", r"for evaluation purposes only", 0.7),
    ("eula", "end user licen", r"end user licen[cs]e agreement", 0.8),
    ("eula", "by installing", r"by installing (?:(?:or|copying|and|otherwise) )*using the software you agree", 0.8),
    ("proprietary", "strictly prohibited", r"unauthori[sz]ed copying (?:of this file )?(?:via any medium )?is strictly prohibited", 0.9),
    ("proprietary", "trade secret", r"(?:contains|constitutes?) (?:confidential )?(?:information and )?trade secrets?", 0.7),
    ("proprietary", "may be reproduced", r"no part of this (?:publication|book|work|document) may be reproduced", 0.8),
    ("proprietary", "used with permission", r"used with permission", 0.4),
    ("reserved", "rights not expressly", r"(?:all )?rights not expressly granted (?:herein )?are reserved", 0.8),
    ("warranty", "merchantability", r"merchantability (?:and |or )?fitness for a particular purpose", 0.6),
    ("warranty", "no event shall", r"in no event shall (?:[^ ]+ ){1,8}?be liable", 0.6),
    ("warranty", "use at your own risk", r"use at your own risk", 0.3),
    ("cla", "contributor licen", r"(?:individual |corporate )?contributor licen[cs]e agreement", 0.6),
    ("dco", "developer certificate", r"developer certificate of origin(?: version 1 1)?", 0.6),
)

_VERSION = r"(?:version |v )?"


def _family(label: str, keyword: str, name: str, versions: tuple[str, ...], grants: bool) -> list[Signature]:
    """A license's names: by version with 'or later' and 'only', then bare."""
    out = []
    for v in versions:
        number = v.replace(".", " ")
        tail = r"(?: 0)?" if "." not in v else ""
        named = rf"{name} {_VERSION}{number}{tail}"
        if grants:
            out.append(Signature(f"{label}-{v}-or-later", keyword, rf"{named} (?:of the license )?or (?:at your option )?(?:any )?later(?: version)?", 0.98))
            out.append(Signature(f"{label}-{v}-only", keyword, rf"{named} only", 0.97))
        out.append(Signature(f"{label}-{v}", keyword, named, 0.95))
        out.append(Signature(f"{label}-{v}", "spdx", rf"spdx license identifier {label.replace('-', ' ')} {number}{tail}", 1.0))
    out.append(Signature(label, keyword, name, 0.8))
    return out


def signatures() -> tuple[Signature, ...]:
    """The rules in order of priority: base phrases, then families, from exact statements to bare names."""
    rules = [Signature(label, phrase, phrase, 0.6, True) for phrase, label in BASE]
    gnu = r"(?:gnu )?"
    for label, name, versions in (
        ("agpl", rf"{gnu}affero general public licen[cs]e", ("1.0", "2.0", "3.0", "3")),
        ("lgpl", rf"{gnu}(?:lesser|library) general public licen[cs]e", ("2.0", "2.1", "3.0", "2", "3")),
        ("gpl", rf"{gnu}general public licen[cs]e", ("1.0", "2.0", "3.0", "1", "2", "3")),
        ("gfdl", rf"{gnu}free documentation licen[cs]e", ("1.1", "1.2", "1.3")),
    ):
        rules += _family(label, "free documentation" if label == "gfdl" else "general public", name, versions, True)
        rules.append(Signature(label, label, rf"{label}(?: (?:v ?)?\d+(?: \d+)?)?", 0.7))
    for label, keyword, name, versions in (
        ("apache", "apache", r"apache (?:software )?licen[cs]e", ("1.0", "1.1", "2.0")), ("mpl", "mozilla", r"mozilla public licen[cs]e", ("1.0", "1.1", "2.0")),
        ("epl", "eclipse", r"eclipse public licen[cs]e", ("1.0", "2.0")), ("cddl", "development and distribution", r"common development and distribution licen[cs]e", ("1.0", "1.1")),
        ("cpl", "common public", r"common public licen[cs]e", ("1.0",)), ("osl", "open software", r"open software licen[cs]e", ("1.0", "2.0", "2.1", "3.0")),
        ("afl", "academic free", r"academic free licen[cs]e", ("1.1", "1.2", "2.0", "2.1", "3.0")), ("artistic", "artistic", r"(?:perl )?artistic licen[cs]e", ("1.0", "2.0")),
        ("eupl", "european union", r"european union public licen[cs]e", ("1.0", "1.1", "1.2")), ("bsl", "boost", r"boost software licen[cs]e", ("1.0",)),
        ("ofl", "sil open font", r"sil open font licen[cs]e", ("1.0", "1.1")), ("zpl", "zope", r"zope public licen[cs]e", ("1.1", "2.0", "2.1")),
        ("php", "php licen", r"php licen[cs]e", ("3.0", "3.01")), ("python", "python software", r"python software foundation licen[cs]e", ("2.0",)),
        ("unlicense", "unlicense", r"the unlicense", ()), ("wtfpl", "wtfpl", r"wtfpl", ("2",)), ("zlib", "zlib licen", r"zlib licen[cs]e", ()), ("isc", "isc licen", r"isc licen[cs]e", ()),
        ("mit", "mit licen", r"mit licen[cs]e", ()), ("busl", "business source", r"business source licen[cs]e", ("1.1",)), ("sspl", "server side", r"server side public licen[cs]e", ("1",)),
        ("odbl", "open database", r"open database licen[cs]e", ("1.0",)), ("pddl", "public domain", r"public domain dedication and licen[cs]e", ("1.0",)),
    ):
        rules += _family(label, keyword, name, versions, False)
    for clauses in ("2", "3", "4"):
        rules.append(Signature(f"bsd-{clauses}-clause", "bsd", rf"bsd {clauses} clause(?: licen[cs]e)?", 0.95))
        rules.append(Signature(f"bsd-{clauses}-clause", "bsd", rf"{clauses} clause bsd(?: licen[cs]e)?", 0.95))
    rules.append(Signature("bsd", "bsd", r"(?:new |modified |simplified )?bsd (?:style )?licen[cs]e", 0.8))
    long_form = {"by": "attribution", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?", "sa": "share ?alike"}
    for parts in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd"):
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            rules.append(Signature(f"cc-{parts}-{v}", "cc by", rf"cc {parts.replace('-', ' ')} {v.replace('.', ' ')}(?: international| unported)?", 0.97))
            rules.append(Signature(f"cc-{parts}-{v}", "creative commons", rf"creative commons {' '.join(long_form[x] for x in parts.split('-'))} {v.replace('.', ' ')}(?: international| unported)?(?: licen[cs]e)?", 0.97))
        rules.append(Signature(f"cc-{parts}", "cc by", rf"cc {parts.replace('-', ' ')}", 0.85))
        rules.append(Signature(f"cc-{parts}", "creative commons", rf"creative commons {' '.join(long_form[x] for x in parts.split('-'))}(?: licen[cs]e)?", 0.85))
    for label, keyword, pattern, weight in (
        ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?", 0.9), ("cc", "creative commons", r"creative commons(?: licen[cs]e)?", 0.6),
        ("public-domain", "public domain", r"(?:released|dedicated|placed|is) (?:in|into|to) the public domain", 0.8), ("public-domain", "public domain", r"public domain", 0.5),
        ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy", 1.0),
        ("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose", 1.0),
        ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification", 1.0),
        ("apache-2.0", "licensed under the apache", r"licensed under the apache licen[cs]e version 2 0", 1.0),
        ("gpl", "free software", r"this (?:program|library) is free software you can redistribute it and or modify it", 1.0),
        ("warranty", "as is without", r"(?:provided )?as is without warranty of any kind", 0.7), ("warranty", "implied warrant", r"without even the implied warranty of merchantability", 0.7),
        ("boost", "boost", r"distributed under the boost software licen[cs]e", 1.0), ("proprietary", "proprietary", r"(?:confidential and )?proprietary(?: and confidential)?(?: information)?", 0.5),
        ("copyright", "copyright", r"copyright (?:c |\(c\) )?(?:19|20)\d\d(?: (?:19|20)\d\d)*", 0.5), ("spdx", "spdx", r"spdx license identifier [a-z0-9]+(?: \d+)*", 0.9),
    ):
        rules.append(Signature(label, keyword, pattern, weight))
    rules += [Signature(*r) for r in WRITTEN]
    return tuple(rules)


def _rules() -> Column:
    rows = [{"rank": k, "label": r.label, "keyword": r.keyword, "pattern": rf"(?is)\G(.*?)((?<![^ ]){r.pattern}(?![^ ]))", "weight": r.weight, "base": r.base} for k, r in enumerate(signatures())]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<rank:int,label:string,keyword:string,pattern:string,weight:double,base:boolean>>")


def gate() -> str:
    """One regex for the whole prefilter, keywords grouped by first letter: a document without any is done after it."""
    heads: dict[str, set[str]] = {}
    for r in signatures():
        heads.setdefault(r.keyword[0], set()).add(r.keyword[1:].replace(" ", SPLIT))
    return r"(?i)(?<![0-9a-z])(?:" + "|".join(f"{h}(?:{'|'.join(sorted(rest))})" for h, rest in sorted(heads.items())) + ")"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, found) per row; found: surviving and base detections (start, end, label, weight, base) by start, words from 0."""
    rows = texts(docs, id_col, text_col).withColumn("rid", F.monotonically_increasing_id())
    rows = rows.withColumn("words", F.array_remove(F.split("text", SPLIT), "")).withColumn("n_words", F.size("words").cast("long"))
    # One pass: what the gate keeps out goes on as a row without rules.
    rows = rows.withColumn("norm", F.when(F.col("text").rlike(gate()), F.array_join("words", " "))).withColumn("low", F.lower("norm"))
    # The text is bound as a lambda variable, so that it is made once and not for every keyword.
    keywords = F.split(F.lit(",".join(sorted({r.keyword for r in signatures()}))), ",")
    held = F.flatten(F.transform(F.array("low"), lambda low: F.filter(keywords, lambda k: F.contains(low, k))))
    asked = rows.withColumn("held", F.when(F.col("norm").isNotNull(), held))
    wanted = F.flatten(F.transform(F.array("held"), lambda held: F.filter(_rules(), lambda r: F.array_contains(held, r["keyword"]))))
    asked = asked.select("rid", "doc_id", "n_words", "norm", F.explode_outer(F.when(F.col("held").isNotNull(), wanted)).alias("r"))
    spaces = lambda s: (F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))).cast("long")
    get = lambda k: F.regexp_extract_all("norm", F.col("r.pattern"), F.lit(k))
    asked = asked.withColumn("m", F.transform(F.arrays_zip(get(1).alias("gap"), get(2).alias("hit")), lambda z: F.struct(spaces(z["gap"]).alias("gap"), spaces(z["hit"]).alias("hit"))))
    hits = asked.select("rid", "doc_id", "n_words", "r", F.posexplode_outer("m").alias("k", "m"))
    # Words before a match: the spaces before it, in the gaps and matches so far.
    run = F.sum(F.col("m.gap") + F.col("m.hit")).over(W.partitionBy("rid", "r.rank").orderBy("k"))
    hits = hits.withColumn("end", run).withColumn("start", F.col("end") - F.col("m.hit"))
    # The furthest end among the detections that start before, or there and end later, or have the same interval and an earlier rule. Base phrases suppress nothing.
    outer = F.max(F.when(F.col("m").isNotNull() & ~F.col("r.base"), F.col("end"))).over(
        W.partitionBy("rid").orderBy(F.col("start"), F.col("end").desc(), F.col("r.rank")).rowsBetween(W.unboundedPreceding, -1)
    )
    hits = hits.withColumn("keep", F.col("r.base") | F.coalesce(outer < F.col("end"), F.lit(True)))
    one = F.when(F.col("m").isNotNull() & F.col("keep"), F.struct("start", "end", F.col("r.label").alias("label"), F.col("r.weight").alias("weight"), F.col("r.base").alias("base")))
    found = hits.groupBy("rid", "doc_id", "n_words").agg(F.sort_array(F.collect_list(one)).alias("found"))
    return found.select("doc_id", "n_words", "found")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns; score is the largest weight found."""
    base, every = F.filter("found", lambda d: d["base"]), F.col("found")
    names = lambda a: F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda d: d["label"]))), ","), F.lit(""))
    start = lambda a, pick: pick(F.transform(a, lambda d: d["start"]))
    return found.select(
        "doc_id", "n_words", F.coalesce(F.size(base), F.lit(0)).cast("long").alias("n_base"), start(base, F.array_min).alias("first_word"), start(base, F.array_max).alias("last_word"),
        names(base).alias("base_labels"), names(every).alias("labels"), F.coalesce(F.array_max(F.transform(every, lambda d: d["weight"])), F.lit(0.0)).alias("score"),
    )
