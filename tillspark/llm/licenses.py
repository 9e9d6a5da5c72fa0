"""Operator 8: licence scan by ordered signature rules, in DataFrame functions only.

Texts that show no licence keyword are only counted.  The others are brought to lower-case words with one
space between them, and each rule whose own keyword they hold is matched.  A match is an interval of words;
one that lies within another of the same or a higher priority is suppressed, as "gnu general public license"
within "gnu general public license version 3".  The three base phrases are rules that are never suppressed.

Cases: a null or empty text has no words and no labels; repeated rows are scanned alike; null ids are kept,
each as a row of its own; a text of any length is scanned whole, however many matches it has; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Characters of words: digits, letters, and all above U+007F; a text's A-Z count as lower case.
WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
SEPARATOR = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The phrases that every scan reports, and their labels.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


@dataclass(frozen=True)
class Rule:
    """A signature: its regex over normalised words, the keyword that it can't match without, its priority
    (3: exact, 2: abbreviated, 1: family only) and how much a match says (0 to 1)."""

    label: str
    regex: str
    keyword: str
    priority: int
    weight: float
    base: bool = False


#: Families: label, name, abbreviation, keyword of the name, versions.
FAMILIES = [
    ("gpl", "gnu general public licen[cs]e", "gpl", "general public licen", "1 2 3"),
    ("lgpl", "gnu (?:lesser|library) general public licen[cs]e", "lgpl", "general public licen", "2 2.1 3"),
    ("agpl", "(?:gnu )?affero general public licen[cs]e", "agpl", "affero", "1 3"),
    ("gfdl", "gnu free documentation licen[cs]e", "gfdl", "documentation licen", "1.1 1.2 1.3"),
    ("apache", "apache(?: software)? licen[cs]e", "apache", "apache", "1 1.1 2"),
    ("mpl", "mozilla public licen[cs]e", "mpl", "mozilla", "1 1.1 2"),
    ("epl", "eclipse public licen[cs]e", "epl", "eclipse", "1 2"),
    ("cddl", "common development and distribution licen[cs]e", "cddl", "distribution licen", "1 1.1"),
    ("cpl", "common public licen[cs]e", "cpl", "common public licen", "1"),
    ("eupl", "european union public licen[cs]e", "eupl", "union public licen", "1 1.1 1.2"),
    ("osl", "open software licen[cs]e", "osl", "open software licen", "1 2 2.1 3"),
    ("afl", "academic free licen[cs]e", "afl", "academic free", "1.2 2 2.1 3"),
    ("artistic", "artistic licen[cs]e", "artistic", "artistic licen", "1 2"),
    ("bsl", "boost software licen[cs]e", "bsl", "boost software", "1"),
    ("ofl", "(?:sil )?open font licen[cs]e", "ofl", "open font", "1 1.1"),
    ("lppl", "latex project public licen[cs]e", "lppl", "latex project", "1 1.1 1.2 1.3"),
    ("zpl", "zope public licen[cs]e", "zpl", "zope", "1.1 2 2.1"),
    ("psf", "python software foundation licen[cs]e", "psf", "software foundation licen", "2"),
    ("php", "php licen[cs]e", "php", "php licen", "3 3.01"),
    ("ms-pl", "microsoft public licen[cs]e", "ms pl", "microsoft public", "1"),
    ("ms-rl", "microsoft reciprocal licen[cs]e", "ms rl", "microsoft reciprocal", "1"),
    ("sspl", "server side public licen[cs]e", "sspl", "server side public", "1"),
    ("elastic", "elastic licen[cs]e", "elastic", "elastic licen", "1 2"),
    ("busl", "business source licen[cs]e", "busl", "business source", "1 1.1"),
    ("odbl", "open database licen[cs]e", "odbl", "open database", "1"),
    ("pddl", "public domain dedication and licen[cs]e", "pddl", "dedication and licen", "1"),
    ("cecill", "cecill(?: free software)? licen[cs]e", "cecill", "cecill", "1 1.1 2 2.1"),
    ("openssl", "openssl licen[cs]e", "openssl", "openssl licen", "1"),
    ("qpl", "q public licen[cs]e", "qpl", "q public licen", "1"),
    ("ncsa", "(?:university of illinois )?ncsa(?: open source)? licen[cs]e", "ncsa", "ncsa", "1"),
]

#: Licences without versions: label, regex, keyword, priority, weight.
NOTICES = [
    ("mit", "(?:the )?mit licen[cs]e", "mit licen", 2, 0.9),
    ("mit", "licen[cs]e mit", "licen", 2, 0.9),
    ("mit", "spdx licen[cs]e identifier mit", "spdx", 3, 1.0),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted", 3, 0.95),
    ("mit", "expat licen[cs]e", "expat", 2, 0.9),
    ("isc", "isc licen[cs]e", "isc licen", 2, 0.9),
    ("isc", "spdx licen[cs]e identifier isc", "spdx", 3, 1.0),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use", 3, 0.95),
    ("bsd", "(?:the )?bsd licen[cs]e", "bsd licen", 1, 0.6),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use", 1, 0.8),
    ("bsd", "(?:the )?(?:new|modified|revised|simplified) bsd licen[cs]e", "bsd licen", 2, 0.9),
    ("zlib", "zlib(?: libpng)? licen[cs]e", "zlib", 2, 0.9),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors", "in no event will the authors", 3, 0.9),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered", 3, 0.95),
    ("unlicense", "the unlicense", "unlicense", 2, 0.9),
    ("wtfpl", "do what the fuck you want to(?: public licen[cs]e)?", "what the fuck you want", 3, 0.9),
    ("wtfpl", "wtfpl", "wtfpl", 2, 0.8),
    ("beerware", "beer ?ware licen[cs]e", "ware licen", 2, 0.9),
    ("cc0", "cc0(?: 1 0)?(?: universal)?", "cc0", 2, 0.9),
    ("cc0", "creative commons zero(?: v?1 0)?(?: universal)?", "creative commons zero", 3, 0.95),
    ("public-domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain", "public domain", 2, 0.8),
    ("public-domain", "(?:is|are) in the public domain", "public domain", 1, 0.6),
    ("proprietary", "all rights reserved", "all rights reserved", 1, 0.5),
    ("proprietary", "proprietary and confidential", "proprietary and", 2, 0.8),
    ("proprietary", "unauthori[sz]ed (?:copying|use|distribution) (?:of this (?:file|software|document) )?(?:is )?(?:strictly )?prohibited", "prohibited", 2, 0.8),
    ("creative-commons", "(?:a )?creative commons licen[cs]e", "creative commons", 1, 0.6),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies", "permission notice", 2, 0.85),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish", "without restriction", 3, 0.9),
    ("mit", "mit x11 licen[cs]e", "mit x11", 2, 0.9),
    ("mit", "mit style licen[cs]e", "mit style", 1, 0.6),
    ("mit-0", "mit no attribution", "no attribution", 3, 0.95),
    ("mit-cmu", "cmu licen[cs]e", "cmu licen", 2, 0.8),
    ("isc", "the author disclaims all warranties with regard to this software", "disclaims all warranties", 2, 0.7),
    ("bsd", "neither the name of (?:the )?(?:\\S+ ){1,8}nor the names of its contributors may be used to endorse", "nor the names of", 2, 0.85),
    ("bsd", "redistributions of source code must retain the above copyright notice", "redistributions of source", 1, 0.7),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice", "redistributions in binary", 1, 0.7),
    ("bsd", "bsd style licen[cs]e", "bsd style", 1, 0.6),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display", "advertising materials", 3, 0.9),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e", "redistribute it and or modify", 2, 0.9),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e", "redistribute it and or modify", 2, 0.9),
    ("gpl", "you should have received a copy of the gnu general public licen[cs]e", "should have received a copy", 2, 0.85),
    ("lgpl", "you should have received a copy of the gnu lesser general public licen[cs]e", "should have received a copy", 2, 0.85),
    ("agpl", "you should have received a copy of the gnu affero general public licen[cs]e", "should have received a copy", 2, 0.85),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e", "and or modify this document", 3, 0.95),
    ("apache", "you may not use this file except in compliance with the licen[cs]e", "except in compliance", 1, 0.7),
    ("apache-2", "you may obtain a copy of the licen[cs]e at http www apache org licen[cs]es licen[cs]e 2 0", "www apache org", 3, 0.95),
    ("apache", "licen[cs]ed to the apache software foundation asf under one or more contributor licen[cs]e agreements", "apache software foundation", 3, 0.9),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0", "source code form", 3, 1.0),
    ("mpl", "the contents of this file are subject to the mozilla public licen[cs]e", "contents of this file are subject", 2, 0.9),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e", "accompanying materials", 2, 0.9),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution licen[cs]e", "contents of this file are subject", 2, 0.9),
    ("bsl-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", "person or organization obtaining", 3, 0.95),
    ("zlib", "altered source versions must be plainly marked as such", "plainly marked", 2, 0.85),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", "free to copy modify publish", 3, 0.9),
    ("artistic", "you may make and give away verbatim copies of the source form", "give away verbatim copies", 2, 0.85),
    ("ofl", "this font software is licen[cs]ed under the sil open font licen[cs]e", "font software is licen", 2, 0.9),
    ("cc0", "to the extent possible under law the (?:author|person|authors) (?:\\S+ ){0,8}(?:has|have) (?:dedicated|waived) all copyright", "extent possible under law", 3, 0.9),
    ("cc-by", "this (?:work|article|book|page) is licen[cs]ed under a creative commons attribution", "creative commons attribution", 2, 0.9),
    ("creative-commons", "some rights reserved", "some rights reserved", 1, 0.5),
    ("public-domain", "no rights reserved", "no rights reserved", 1, 0.6),
    ("public-domain", "this work is free of known copyright restrictions", "known copyright restrictions", 2, 0.8),
    ("proprietary", "this (?:document|file|software) contains confidential information", "confidential information", 2, 0.7),
    ("proprietary", "may not be (?:copied|reproduced|distributed) (?:\\S+ ){0,6}without (?:the )?(?:prior )?(?:express )?written (?:permission|consent)", "written", 1, 0.6),
    ("eula", "end user licen[cs]e agreement", "end user licen", 2, 0.8),
    ("eula", "by (?:installing|using|downloading) (?:this|the) software you agree", "you agree", 1, 0.6),
    ("shareware", "this is shareware", "shareware", 1, 0.6),
    ("freeware", "this (?:software|program) is freeware", "freeware", 1, 0.6),
    ("json", "the software shall be used for good not evil", "for good not evil", 3, 0.95),
    ("ncsa", "university of illinois open source licen[cs]e", "illinois open source", 3, 0.9),
    ("w3c", "w3c software (?:notice and )?licen[cs]e", "w3c software", 2, 0.9),
    ("x11", "x11 licen[cs]e", "x11 licen", 2, 0.8),
    ("curl", "curl licen[cs]e", "curl licen", 2, 0.8),
    ("postgresql", "postgresql licen[cs]e", "postgresql licen", 2, 0.9),
    ("ruby", "ruby licen[cs]e", "ruby licen", 2, 0.8),
    ("perl", "under the same terms as perl(?: itself)?", "same terms as perl", 2, 0.85),
    ("vim", "vim licen[cs]e", "vim licen", 2, 0.8),
    ("gpl", "licen[cs]ed under the gpl", "gpl", 1, 0.7),
    ("dual", "dual licen[cs]ed under", "dual licen", 1, 0.5),
]

#: Licences that are known by their names: label, regex, keyword, priority, weight.
NAMED = [
    ("aladdin", "aladdin free public licen[cs]e", "aladdin", 2, 0.85),
    ("apsl", "apple public source licen[cs]e", "apple public source", 2, 0.85),
    ("attribution-assurance", "attribution assurance licen[cs]e", "attribution assurance", 2, 0.85),
    ("blueoak", "blue oak model licen[cs]e(?: 1 0 0)?", "blue oak", 2, 0.85),
    ("bittorrent", "bittorrent open source licen[cs]e", "bittorrent", 2, 0.85),
    ("cpal", "common public attribution licen[cs]e(?: version)?(?: 1 0)?", "public attribution", 2, 0.85),
    ("catosl", "computer associates trusted open source licen[cs]e", "computer associates", 2, 0.85),
    ("cua-opl", "cua office public licen[cs]e", "cua office", 2, 0.85),
    ("cern-ohl", "cern open hardware licen[cs]e(?: version)?(?: [12](?: [012])?)?(?: (?:permissive|weakly reciprocal|strongly reciprocal))?", "open hardware", 2, 0.85),
    ("cnri-python", "cnri (?:open source licen[cs]e agreement|python licen[cs]e)", "cnri", 2, 0.85),
    ("crypt", "cryptix general licen[cs]e", "cryptix", 2, 0.85),
    ("d-fsl", "deutsche freie software lizenz under this licen[cs]e", "freie software", 2, 0.85),
    ("efl", "eiffel forum licen[cs]e(?: version)?(?: [12])?", "eiffel forum", 2, 0.85),
    ("entessa", "entessa public licen[cs]e", "entessa", 2, 0.85),
    ("ecos", "ecos licen[cs]e(?: version 2 0)?", "ecos licen", 2, 0.85),
    ("ecl", "educational community licen[cs]e(?: version)?(?: [12] 0)?", "educational community", 2, 0.85),
    ("erlang", "erlang public licen[cs]e(?: 1 1)?", "erlang public", 2, 0.85),
    ("eudatagrid", "eu datagrid software licen[cs]e", "datagrid", 2, 0.85),
    ("fair", "(?:the )?fair licen[cs]e (?:fair|usage of the works)", "fair licen", 2, 0.85),
    ("frameworx", "frameworx open licen[cs]e", "frameworx", 2, 0.85),
    ("freetype", "(?:the )?freetype (?:project )?licen[cs]e", "freetype", 2, 0.85),
    ("giftware", "(?:the )?giftware licen[cs]e", "giftware", 2, 0.85),
    ("gust-font", "gust font licen[cs]e", "gust font", 2, 0.85),
    ("hippocratic", "hippocratic licen[cs]e(?: [123] [01])?", "hippocratic", 2, 0.85),
    ("hpnd", "historical permission notice and disclaimer licen[cs]e?", "historical permission", 2, 0.85),
    ("ipl", "ibm public licen[cs]e(?: 1 0)?", "ibm public", 2, 0.85),
    ("imagemagick", "imagemagick licen[cs]e", "imagemagick", 2, 0.85),
    ("ijg", "independent jpeg group(?: s)? licen[cs]e", "jpeg group", 2, 0.85),
    ("info-zip", "info ?zip licen[cs]e", "zip licen", 2, 0.85),
    ("intel", "intel open source licen[cs]e", "intel open", 2, 0.85),
    ("interbase", "interbase public licen[cs]e", "interbase", 2, 0.85),
    ("ipa", "ipa font licen[cs]e(?: agreement)?(?: v1 0)?", "ipa font", 2, 0.85),
    ("jasper", "jasper licen[cs]e(?: version 2 0)?", "jasper licen", 2, 0.85),
    ("libpng", "(?:png reference library|libpng) licen[cs]e(?: version 2)?", "png", 2, 0.85),
    ("lal", "(?:free art licen[cs]e|licen[cs]e art libre)(?: 1 [23])?", "art", 2, 0.85),
    ("lpl", "lucent public licen[cs]e(?: version)?(?: 1 0(?: 2)?)?", "lucent public", 2, 0.85),
    ("miros", "(?:the )?miros licen[cs]e", "miros", 2, 0.85),
    ("motosoto", "motosoto(?: open source)? licen[cs]e", "motosoto", 2, 0.85),
    ("mulan", "mulan (?:permissive software|public) licen[cs]e(?: version)?(?: [12])?", "mulan", 2, 0.85),
    ("nasa", "nasa open source agreement under this licen[cs]e", "nasa open", 2, 0.85),
    ("naumen", "naumen public licen[cs]e", "naumen", 2, 0.85),
    ("net-snmp", "net snmp licen[cs]e", "snmp", 2, 0.85),
    ("npl", "netscape public licen[cs]e(?: version)?(?: 1 [01])?", "netscape public", 2, 0.85),
    ("ngpl", "nethack general public licen[cs]e", "nethack", 2, 0.85),
    ("nokia", "nokia open source licen[cs]e", "nokia open", 2, 0.85),
    ("nposl", "non ?profit open software licen[cs]e(?: 3 0)?", "profit open software", 2, 0.85),
    ("nosl", "netizen open source licen[cs]e", "netizen", 2, 0.85),
    ("ntp", "ntp licen[cs]e(?: attribution)?", "ntp licen", 2, 0.85),
    ("oclc", "oclc research public licen[cs]e(?: 2 0)?", "oclc research", 2, 0.85),
    ("ogtsl", "open group test suite licen[cs]e", "test suite licen", 2, 0.85),
    ("ogl", "open government licen[cs]e(?: v?[123] 0)?", "open government", 2, 0.85),
    ("opl", "open publication licen[cs]e(?: v?(?:0 4|1 0))?", "open publication", 2, 0.85),
    ("oldap", "(?:the )?openldap public licen[cs]e(?: version)?(?: 2 [0-8])?", "openldap", 2, 0.85),
    ("parity", "parity public licen[cs]e(?: [67] 0 0)?", "parity public", 2, 0.85),
    ("polyform", "polyform (?:noncommercial|non commercial|small business|shield|strict|perimeter|internal use|free trial) licen[cs]e(?: 1 0 0)?", "polyform", 2, 0.85),
    ("prosperity", "prosperity public licen[cs]e(?: 3 0 0)?", "prosperity public", 2, 0.85),
    ("commons-clause", "commons clause licen[cs]e(?: condition)?(?: v1 0)?", "commons clause", 2, 0.85),
    ("rpl", "reciprocal public licen[cs]e(?: 1 [15])?", "reciprocal public", 2, 0.85),
    ("rpsl", "realnetworks public source licen[cs]e", "realnetworks", 2, 0.85),
    ("rscpl", "ricoh source code public licen[cs]e", "ricoh", 2, 0.85),
    ("sleepycat", "(?:the )?sleepycat(?: software product)? licen[cs]e", "sleepycat", 2, 0.85),
    ("simpl", "simple public licen[cs]e(?: 2 0)?", "simple public", 2, 0.85),
    ("spl", "sun public licen[cs]e(?: version)?(?: 1 0)?", "sun public", 2, 0.85),
    ("sissl", "sun industry standards source licen[cs]e", "industry standards source", 2, 0.85),
    ("watcom", "sybase open watcom public licen[cs]e(?: 1 0)?", "watcom", 2, 0.85),
    ("tcl", "tcl(?: tk)? licen[cs]e", "tcl", 2, 0.85),
    ("tmate", "tmate open source licen[cs]e", "tmate", 2, 0.85),
    ("torque", "torque v2 5 software licen[cs]e", "torque", 2, 0.85),
    ("upl", "universal permissive licen[cs]e(?: v?1 0)?", "universal permissive", 2, 0.85),
    ("unicode", "unicode (?:licen[cs]e agreement data files and software|terms of use licen[cs]e|licen[cs]e)", "unicode", 2, 0.85),
    ("ucl", "upstream compatibility licen[cs]e(?: v?1 0)?", "upstream compatibility", 2, 0.85),
    ("vovida", "vovida software licen[cs]e(?: v?1 0)?", "vovida", 2, 0.85),
    ("wxwindows", "wxwindows library licen[cs]e(?: version 3(?: 1)?)?", "wxwindows", 2, 0.85),
    ("xnet", "x net licen[cs]e", "x net licen", 2, 0.85),
    ("xfree86", "xfree86 licen[cs]e(?: 1 1)?", "xfree86", 2, 0.85),
    ("ypl", "yahoo public licen[cs]e(?: 1 [01])?", "yahoo public", 2, 0.85),
    ("zed", "(?:the )?zed licen[cs]e", "zed licen", 2, 0.85),
    ("zend", "zend(?: engine)? licen[cs]e(?: v?2 0)?", "zend", 2, 0.85),
    ("0bsd", "(?:bsd zero clause|zero clause bsd|0bsd|free public) licen[cs]e(?: 1 0 0)?", "licen", 2, 0.85),
    ("bzip2", "bzip2(?: and libbzip2)? licen[cs]e(?: v?1 0 [56])?", "bzip2", 2, 0.85),
    ("libtiff", "libtiff licen[cs]e", "libtiff", 2, 0.85),
    ("noweb", "noweb licen[cs]e", "noweb", 2, 0.85),
    ("npsl", "nmap public source licen[cs]e", "nmap", 2, 0.85),
    ("odc-by", "open data commons attribution licen[cs]e(?: v?1 0)?", "data commons attribution", 2, 0.85),
    ("odc", "open data commons licen[cs]e", "open data commons", 2, 0.85),
    ("cdla", "community data licen[cs]e agreement(?: (?:permissive|sharing))?(?: version)?(?: [12] 0)?", "community data", 2, 0.85),
    ("llama", "(?:meta )?llama [234](?: [123])? community licen[cs]e(?: agreement)?", "llama", 2, 0.85),
    ("openrail", "(?:bigscience |bigcode |creativeml )?open ?rail(?: m)? licen[cs]e", "rail", 2, 0.85),
    ("bigscience-rail", "bigscience rail licen[cs]e(?: v?1 0)?", "bigscience rail", 2, 0.85),
    ("gemma", "gemma (?:terms of use )?licen[cs]e", "gemma", 2, 0.85),
    ("falcon", "falcon (?:180b|llm|2) tii licen[cs]e", "falcon", 2, 0.85),
    ("apple-sample", "apple sample (?:source )?code licen[cs]e", "apple sample", 2, 0.85),
    ("android-sdk", "android software development kit licen[cs]e agreement", "development kit licen", 2, 0.85),
    ("otn", "oracle technology network licen[cs]e agreement", "oracle technology", 2, 0.85),
    ("oracle-nftc", "oracle no fee terms and conditions licen[cs]e", "oracle no fee", 2, 0.85),
    ("sun-bcl", "(?:sun microsystems inc |oracle )?binary code licen[cs]e agreement", "binary code", 2, 0.85),
    ("ms-terms", "microsoft software licen[cs]e(?: terms)?", "microsoft software", 2, 0.85),
    ("ms-shared", "microsoft (?:limited public|limited reciprocal|shared source|reference source) licen[cs]e", "microsoft", 2, 0.85),
    ("nvidia", "nvidia (?:software|cuda toolkit|source code|open model) licen[cs]e(?: agreement)?", "nvidia", 2, 0.85),
    ("unsplash", "unsplash licen[cs]e", "unsplash", 2, 0.85),
    ("pixabay", "pixabay(?: content)? licen[cs]e", "pixabay", 2, 0.85),
    ("pexels", "pexels licen[cs]e", "pexels", 2, 0.85),
    ("dsl", "design science licen[cs]e", "design science", 2, 0.85),
    ("against-drm", "against drm licen[cs]e(?: 2 0)?", "against drm", 2, 0.85),
    ("ppl", "peer production licen[cs]e", "peer production", 2, 0.85),
    ("anti-996", "anti 996 licen[cs]e(?: version 1 0)?", "anti 996", 2, 0.85),
    ("do-no-harm", "do no harm licen[cs]e", "no harm licen", 2, 0.85),
    ("jython", "jython licen[cs]e", "jython", 2, 0.85),
    ("gcc-exception", "gcc runtime library exception to the licen[cs]e", "gcc runtime", 2, 0.85),
    ("classpath-exception", "classpath exception to the licen[cs]e", "classpath", 2, 0.85),
    ("font-exception", "font exception to the licen[cs]e", "font exception", 2, 0.85),
    ("autoconf-exception", "autoconf (?:configure script )?exception to the licen[cs]e", "autoconf", 2, 0.85),
    ("bison-exception", "bison exception to the licen[cs]e", "bison exception", 2, 0.85),
    ("syscall-note", "linux syscall note to the licen[cs]e", "syscall", 2, 0.85),
    ("llvm-exception", "llvm exceptions? to the (?:apache )?licen[cs]e", "llvm", 2, 0.85),
    ("foss-exception", "universal foss exception to the licen[cs]e", "foss exception", 2, 0.85),
    ("qt-exception", "(?:the )?qt (?:company )?lgpl exception to the licen[cs]e", "lgpl exception", 2, 0.85),
    ("qt-commercial", "qt commercial licen[cs]e(?: agreement)?", "qt commercial", 2, 0.85),
    ("gpl-cc", "gpl cooperation commitment licen[cs]e", "cooperation commitment", 2, 0.85),
    ("adobe", "adobe (?:glyph list|postscript amd|source code|display postscript) licen[cs]e", "adobe", 2, 0.85),
    ("afmparse", "afmparse licen[cs]e", "afmparse", 2, 0.85),
    ("amdplpa", "amd(?: s)? plpa map c licen[cs]e", "plpa", 2, 0.85),
    ("apafml", "adobe postscript afm licen[cs]e", "afm licen", 2, 0.85),
    ("artistic-perl", "(?:the )?perl artistic licen[cs]e", "perl artistic", 2, 0.85),
    ("bsd-patent", "bsd (?:plus patent|2 clause plus patent|2 clause patent) licen[cs]e", "patent licen", 2, 0.85),
    ("bsd-clear", "(?:the )?clear bsd licen[cs]e", "clear bsd", 2, 0.85),
    ("bsd-lbnl", "lawrence berkeley national labs bsd(?: variant)? licen[cs]e", "berkeley", 2, 0.85),
    ("clartistic", "clarified artistic licen[cs]e", "clarified artistic", 2, 0.85),
    ("condor", "condor public licen[cs]e(?: v?1 [01])?", "condor public", 2, 0.85),
    ("dotseqn", "dotseqn licen[cs]e", "dotseqn", 2, 0.85),
    ("doc", "doc software licen[cs]e", "doc software", 2, 0.85),
    ("egenix", "egenix com public licen[cs]e(?: 1 1 0)?", "egenix", 2, 0.85),
    ("etalab", "etalab open licen[cs]e(?: 2 0)?", "etalab", 2, 0.85),
    ("eurosym", "eurosym licen[cs]e", "eurosym", 2, 0.85),
    ("gl2ps", "gl2ps licen[cs]e", "gl2ps", 2, 0.85),
    ("glide", "3dfx glide licen[cs]e", "glide", 2, 0.85),
    ("glulxe", "glulxe licen[cs]e", "glulxe", 2, 0.85),
    ("gsoap", "gsoap public licen[cs]e(?: v?1 3(?: b)?)?", "gsoap", 2, 0.85),
    ("haskell-report", "haskell language report licen[cs]e", "haskell", 2, 0.85),
    ("icu", "icu licen[cs]e", "icu licen", 2, 0.85),
    ("iec", "iec code components end user licen[cs]e", "code components", 2, 0.85),
    ("isc-veillard", "isc veillard(?: variant)? licen[cs]e", "veillard", 2, 0.85),
    ("japan-standard", "japan network information center licen[cs]e", "network information center", 2, 0.85),
    ("knuth", "knuth ctan licen[cs]e", "knuth", 2, 0.85),
    ("latex2e", "latex2e licen[cs]e", "latex2e", 2, 0.85),
    ("leptonica", "leptonica licen[cs]e", "leptonica", 2, 0.85),
    ("lgpllr", "lesser general public licen[cs]e for linguistic resources", "linguistic resources", 2, 0.85),
    ("liliq", "licence libre du quebec (?:permissive|reciprocite)(?: v1 1)?", "libre du quebec", 2, 0.85),
    ("makeindex", "makeindex licen[cs]e", "makeindex", 2, 0.85),
    ("mtll", "matrix template library licen[cs]e", "matrix template", 2, 0.85),
    ("mup", "mup licen[cs]e", "mup licen", 2, 0.85),
    ("openvision", "open ?vision licen[cs]e", "vision licen", 2, 0.85),
    ("oset-pl", "oset public licen[cs]e(?: version)?(?: 2 1)?", "oset public", 2, 0.85),
    ("plexus", "plexus classworlds licen[cs]e", "plexus", 2, 0.85),
    ("psutils", "psutils licen[cs]e", "psutils", 2, 0.85),
    ("sgi-b", "sgi free software licen[cs]e(?: b)?(?: v?(?:1 [01]|2 0))?", "sgi free", 2, 0.85),
    ("snia", "snia public licen[cs]e(?: 1 1)?", "snia", 2, 0.85),
    ("spencer", "(?:henry )?spencer licen[cs]e(?: (?:86|94|99))?", "spencer", 2, 0.85),
    ("tapr-ohl", "tapr open hardware licen[cs]e(?: v?1 0)?", "tapr", 2, 0.85),
    ("vostrom", "vostrom public licen[cs]e", "vostrom", 2, 0.85),
    ("vsl", "vovida public software licen[cs]e", "vovida public", 2, 0.85),
    ("xpp", "xpp licen[cs]e", "xpp licen", 2, 0.85),
    ("xskat", "xskat licen[cs]e", "xskat", 2, 0.85),
]

#: Creative Commons: the elements of a licence in their order, spelled out.
ELEMENTS = {"nc": "non ?commercial", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s?(?: works)?"}
CC_KINDS = [(), ("nc",), ("sa",), ("nd",), ("nc", "sa"), ("nc", "nd")]
CC_VERSIONS = ["1", "2", "2.5", "3", "4"]
NOTICE = "(?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?"


def _version(version: str) -> str:
    """A version as words, with or without a zero behind a whole number."""
    numbers = " ".join(version.split("."))
    return f"(?:version |ver |v )?v?{numbers}" + ("" if "." in version else "(?: 0)?")


def rules() -> list[Rule]:
    """All signatures, from the tables above."""
    out = [Rule(label, phrase, phrase, 3, 1.0, True) for phrase, label in BASE_PHRASES.items()]
    out += [Rule(*x) for x in NOTICES + NAMED]
    for label, name, short, keyword, versions in FAMILIES:
        out.append(Rule(label, f"(?:the )?{name}", keyword, 1, 0.6))
        out.append(Rule(label, f"{NOTICE}{name}", keyword, 2, 0.8))
        for v in versions.split():
            full = f"{label}-{v}"
            out.append(Rule(full, f"(?:{NOTICE})?(?:the )?{name} {_version(v)}(?: only| or (?:any )?later(?: version)?)?", keyword, 3, 0.95))
            out.append(Rule(full, f"spdx licen[cs]e identifier {short} {_version(v)}(?: only| or later)?", "spdx", 3, 1.0))
            out.append(Rule(full, f"(?:licen[cs]ed under|licen[cs]e) (?:the )?{short} ?{_version(v)}", short, 2, 0.85))
    for n in (2, 3, 4):
        out.append(Rule(f"bsd-{n}-clause", f"(?:the )?bsd {n} clause(?: licen[cs]e)?", "bsd", 3, 0.95))
        out.append(Rule(f"bsd-{n}-clause", f"(?:the )?{n} clause bsd(?: licen[cs]e)?", "clause bsd", 3, 0.95))
    for kind, version in product(CC_KINDS, [None, *CC_VERSIONS]):
        label = "-".join(["cc", "by", *kind, *([version] if version else [])])
        tail = f" {_version(version)}(?: international| unported)?" if version else ""
        spelled = "".join(f" {ELEMENTS[k]}" for k in kind)
        exact = 3 if version else 2
        out.append(Rule(label, f"cc {' '.join(['by', *kind])}{tail}", "cc by", exact, 0.9))
        out.append(Rule(label, f"creative commons attribution{spelled}{tail}(?: licen[cs]e)?", "creative commons attribution", exact, 0.95))
    return out


#: Every rule's match holds one of these words or, for rules without a telling word, pairs of words.
PAIRS = [
    "deal in", "no attribution", "disclaims all", "nor the", "advertising materials", "altered source", "anyone is", "verbatim copies",
    "extent possible", "copyright restrictions", "confidential information", "written consent", "you agree", "not evil", "as perl", "public domain",
]
PREFILTER = (
    "(?i)licen[cs]|spdx|hereby|permission|redistribution|unencumbered|wtfpl|fuck|cc0|creative|reserved|proprietary|prohibited|bsd|event|shareware|freeware"
    f"|(?<![0-9A-Za-z])(?:{'|'.join(p.replace(' ', SEPARATOR + '+') for p in ['cc by', *PAIRS])})"
)


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def matches(docs: DataFrame, found: list[Rule] | None = None) -> DataFrame:
    """One row per match, before suppression: row, label, priority, weight, base, first and last word.

    ``docs`` holds row (a number per document) and norm (its words, a space before and behind each).
    """
    by_keyword: dict[str, list[Column]] = {}
    for k, r in enumerate(found or rules()):
        by_keyword.setdefault(r.keyword, []).append(F.struct(F.lit(k).alias("rule"), *(F.lit(getattr(r, c)).alias(c) for c in ("label", "priority", "weight", "base")), F.lit(f"(?<= ){r.regex}(?= )").alias("regex")))
    # a keyword is looked for once, whatever the number of its rules
    table = F.array(*(F.struct(F.lit(k).alias("keyword"), F.array(*own).alias("rules")) for k, own in by_keyword.items()))
    shown = F.filter(table, lambda g: F.contains(F.col("norm"), g["keyword"]))
    gated = docs.select("row", "norm", F.explode(F.flatten(F.transform(shown, lambda g: g["rules"]))).alias("r"))
    hits = gated.select("row", "r", F.expr("regexp_extract_all(norm, r.regex, 0)").alias("hit"), "norm").where(F.size("hit") > 0)
    # the words before a match: those in the parts before it, and in the matches before it
    parts = hits.select("row", "r", F.transform("hit", _spaces).alias("h"), F.transform(F.expr("split(norm, r.regex)"), _spaces).alias("p"))
    single = parts.select("row", "r.rule", "r.label", "r.priority", "r.weight", "r.base", F.posexplode("h").alias("k", "h"), "p")
    single = single.withColumn("p", F.get("p", F.col("k"))).repartition("row")
    last = F.sum(F.col("p") + F.col("h")).over(Window.partitionBy("row", "rule").orderBy("k")) - 1
    return single.withColumn("last", last.cast("int")).select("row", "label", "priority", "weight", "base", (F.col("last") - F.col("h")).alias("first"), "last")


def surviving(found: DataFrame) -> DataFrame:
    """``matches`` without those that lie within another of the same or a higher priority."""
    order = "PARTITION BY row ORDER BY first, last DESC, priority DESC, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    # a match that holds this one comes before it in this order
    reach = [F.expr(f"max(CASE WHEN priority >= {p} THEN last END) OVER ({order})") for p in (1, 2, 3)]
    held = F.element_at(F.array(*reach), F.col("priority")) >= F.col("last")
    return found.withColumn("held", F.coalesce(held, F.lit(False))).where("base OR NOT held").drop("held")


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score (of its strongest surviving match)."""
    text = F.coalesce("text", F.lit(""))
    shown = F.when(text.rlike(PREFILTER), text).alias("shown")
    counted = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"), shown)
    counted = staged(counted, "counted")
    words = F.regexp_extract_all(F.translate("shown", UPPER, LOWER), F.lit(WORD), F.lit(0))
    norm = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    kept = surviving(matches(counted.where("shown IS NOT NULL").select("row", norm.alias("norm"))))
    base = F.col("base")
    labels = kept.groupBy("row").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("weight").alias("score"),
    )
    out = counted.drop("shown").join(labels, "row", "left")
    zero = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    return out.select("doc_id", "n_words", *(F.coalesce(c, zero[c]).alias(c) if c in zero else c for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score")))
