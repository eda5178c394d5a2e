"""Signature rules of the license scan.

A rule is a regular expression over lower-cased words joined by single spaces,
matched from its keyword, the first word, on. Rules are ordered by priority: 1
a grant or a license text, 2 a named license with its version or terms, 3 a
mention. ``licenses`` lists the named licenses; each gets the same set of
signatures (grant, version, mention, identifier), the rest is written out.
"""

from __future__ import annotations

import re

#: (label, name, version) of each license: the name starts with a plain word; versions are given as words.
LICENSES = (
    ("academic-free-3.0", "academic free", "3 0"),
    ("affero-gpl-1.0", "affero general public", "1 0"),
    ("agpl-3.0", "gnu affero general public", "3( 0)?"),
    ("apache-1.0", "apache( software)?", "1 0"),
    ("apache-1.1", "apache( software)?", "1 1"),
    ("apache-2.0", "apache( software)?", "2( 0)?"),
    ("apple-psl-2.0", "apple public source", "2 0"),
    ("artistic-1.0", "artistic", "1 0"),
    ("artistic-2.0", "artistic", "2 0"),
    ("beerware", "beerware", ""),
    ("boost-1.0", "boost software", "1 0"),
    ("bsd-0-clause", "bsd (0|zero) clause", ""),
    ("bsd-1-clause", "bsd 1 clause", ""),
    ("bsd-2-clause", "bsd 2 clause( simplified)?", ""),
    ("bsd-3-clause", "bsd 3 clause( new| revised)?", ""),
    ("bsd-4-clause", "bsd 4 clause( original)?", ""),
    ("bsd-simplified", "simplified bsd", ""),
    ("bsd-new", "new bsd", ""),
    ("bsd-modified", "modified bsd", ""),
    ("bsd", "bsd( style)?", ""),
    ("cddl-1.0", "common development and distribution", "1 0"),
    ("cddl-1.1", "common development and distribution", "1 1"),
    ("cecill-2.1", "cecill( free software)?", "2 1"),
    ("cpal-1.0", "common public attribution", "1 0"),
    ("cpl-1.0", "common public", "1 0"),
    ("eclipse-1.0", "eclipse public", "1 0"),
    ("eclipse-2.0", "eclipse public", "2 0"),
    ("edl-1.0", "eclipse distribution", "1 0"),
    ("eupl-1.1", "european union public", "1 1"),
    ("eupl-1.2", "european union public", "1 2"),
    ("gfdl-1.1", "gnu free documentation", "1 1"),
    ("gfdl-1.2", "gnu free documentation", "1 2"),
    ("gfdl-1.3", "gnu free documentation", "1 3"),
    ("gpl-1.0", "gnu general public", "1( 0)?"),
    ("gpl-2.0", "gnu general public", "2( 0)?"),
    ("gpl-3.0", "gnu general public", "3( 0)?"),
    ("ibm-pl-1.0", "ibm public", "1 0"),
    ("isc", "isc", ""),
    ("lgpl-2.0", "gnu library general public", "2( 0)?"),
    ("lgpl-2.1", "gnu lesser general public", "2 1"),
    ("lgpl-3.0", "gnu lesser general public", "3( 0)?"),
    ("lppl-1.3", "latex project public", "1 3(a|b|c)?"),
    ("mit", "mit", ""),
    ("mit-x11", "x11", ""),
    ("mit-expat", "expat", ""),
    ("mit-0", "mit (0|no attribution)", ""),
    ("mpl-1.0", "mozilla public", "1 0"),
    ("mpl-1.1", "mozilla public", "1 1"),
    ("mpl-2.0", "mozilla public", "2 0"),
    ("ms-pl", "microsoft public", ""),
    ("ms-rl", "microsoft reciprocal", ""),
    ("mulan-psl-2", "mulan permissive software", "2"),
    ("ncsa", "university of illinois( ncsa)? open source", ""),
    ("netscape-1.1", "netscape public", "1 1"),
    ("odbl-1.0", "open database", "1 0"),
    ("odc-by-1.0", "open data commons attribution", "1 0"),
    ("ofl-1.1", "sil open font", "1 1"),
    ("open-software-3.0", "open software", "3 0"),
    ("openssl", "openssl", ""),
    ("php-3.01", "php", "3 0(1| 1)"),
    ("postgresql", "postgresql", ""),
    ("psf-2.0", "python software foundation", "(2|2 0)"),
    ("python-2.0", "python", "2 0"),
    ("qpl-1.0", "q public", "1 0"),
    ("ruby", "ruby", ""),
    ("sleepycat", "sleepycat", ""),
    ("sun-pl-1.0", "sun public", "1 0"),
    ("universal-permissive-1.0", "universal permissive", "1 0"),
    ("unlicense", "unlicense", ""),
    ("vim", "vim", ""),
    ("w3c", "w3c( software)?", ""),
    ("wtfpl", "wtfpl", "2"),
    ("zlib", "zlib( libpng)?", ""),
    ("zope-2.1", "zope public", "2 1"),
)

#: Words that open a grant.
GRANTS = ("licensed", "released", "distributed")

_TERMS = "(the )?(terms (and conditions )?of (the )?)?"
_VERSION = "(version |v )?"

#: (priority, label, pattern, weight) of the signatures that stand for themselves.
TEXTS = (
    (1, "mit", "permission is hereby granted free of charge to any person obtaining a copy", 1.0),
    (1, "isc", "permission to use copy modify and( or)? distribute this software for any purpose with or without fee", 1.0),
    (1, "bsd", "redistribution and use in source and binary forms with or without modification are permitted", 1.0),
    (1, "bsd-3-clause", "redistributions? of source code must retain the above copyright notice", 0.9),
    (1, "bsd-3-clause", "redistributions? in binary form must reproduce the above copyright notice", 0.9),
    (1, "gpl", "redistribute it and or modify it under the terms of the gnu general public license", 1.0),
    (1, "lgpl", "redistribute it and or modify it under the terms of the gnu lesser general public license", 1.0),
    (1, "agpl", "redistribute it and or modify it under the terms of the gnu affero general public license", 1.0),
    (1, "unlicense", "unencumbered software released into the public domain", 1.0),
    (1, "cc0-1.0", "dedicated the work to the public domain", 0.9),
    (1, "wtfpl", "do what the fuck you want to public license", 1.0),
    (1, "zlib", "permission is granted to anyone to use this software for any purpose", 1.0),
    (1, "gfdl", "permission is granted to copy distribute and or modify this document", 1.0),
    (1, "public-domain", "released into the public domain", 0.9),
    (1, "public-domain", "(placed|dedicated) (in|to) the public domain", 0.9),
    (2, "gpl-3.0", "gplv3", 0.8),
    (2, "gpl-2.0", "gplv2", 0.8),
    (2, "lgpl-2.1", "lgplv2( 1)?", 0.8),
    (2, "lgpl-3.0", "lgplv3", 0.8),
    (2, "agpl-3.0", "agplv3", 0.8),
    (2, "gpl-or-later", "general public license (version )?[1-3] or( any)? later", 0.9),
    (2, "cc0-1.0", "cc0( 1 0)?", 0.8),
    (3, "public-domain", "public domain", 0.5),
    (3, "gpl", "gnu gpl", 0.6),
    (3, "lgpl", "gnu lgpl", 0.6),
    (3, "creative-commons", "creative commons", 0.5),
    (3, "no-warranty", "without warranty of any kind", 0.5),
    (3, "no-warranty", "without any warranty", 0.5),
    (3, "copyright", "copyright( c)? [12][0-9][0-9][0-9]", 0.4),
    (3, "copyright", "copyright notice", 0.3),
    (3, "reserved", "some rights reserved", 0.5),
    (3, "reserved", "no rights reserved", 0.5),
    (3, "permission", "used (by|with) permission", 0.3),
    (3, "proprietary", "proprietary and confidential", 0.6),
    (3, "license-mention", "licensed under", 0.3),
    (3, "license-mention", "license agreement", 0.3),
)

#: Notices, clauses, exceptions and references as licenses and files word them: (priority, label, pattern, weight).
#: Each starts with a word that is rare in plain prose, as every place of it is looked at.
NOTICES = (
    # permissive notices and their conditions
    (1, "mit", "permission notice shall be included in all copies or substantial portions of the software", 1.0),
    (1, "mit", "rights to use copy modify merge publish distribute sublicense and( or)? sell copies of the software", 1.0),
    (1, "mit-0", "permission is hereby granted free of charge to any person obtaining a copy of this software .{0,80}?to deal in the software without restriction", 1.0),
    (1, "mit-expat", "authors or copyright holders be liable for any claim damages or other liability", 0.9),
    (1, "isc", "permission to use copy modify( and)? distribute this software and its documentation for any purpose (and without fee )?is hereby granted", 1.0),
    (1, "bsd-4-clause", "advertising materials mentioning features or use of this software must display", 1.0),
    (1, "bsd-3-clause", "neither the names? of .{1,90}? nor the names of its contributors may be used to endorse or promote products", 1.0),
    (1, "bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors", 1.0),
    (1, "bsd", "copyright holders and contributors as is and any express or implied warranties", 0.9),
    (1, "bsd-2-clause", "redistributions? of source code must retain the above copyright notice this list of conditions and the following disclaimer( 2)?", 0.9),
    (1, "bsd-source-code", "redistributions of source code must retain the copyright notices as they appear", 0.9),
    (1, "bsd-patent", "patent license .{1,60}? to make have made use offer to sell sell import and otherwise transfer this software", 0.9),
    (1, "zlib", "altered source versions must be plainly marked as such", 1.0),
    (1, "zlib", "misrepresented you must not claim that you wrote the original software", 1.0),
    (1, "libpng", "permission is hereby granted to use copy modify and distribute this source code or portions hereof", 1.0),
    (1, "boost-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software", 1.0),
    (1, "ncsa", "redistributions in binary form must reproduce the above copyright notice .{1,60}? documentation and( or)? other materials provided with the distribution neither the names of", 0.9),
    (1, "postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement", 1.0),
    (1, "hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted provided that", 1.0),
    (1, "mit-x11", "except as contained in this notice the names? of .{1,60}? shall not be used in advertising", 1.0),
    (1, "fsf-all-permissive", "copying and distribution of this file with or without modification are permitted in any medium without royalty", 1.0),
    (1, "fsf-unlimited", "gives unlimited permission to copy and( or)? distribute it with or without modifications", 1.0),
    (1, "curl", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice", 1.0),
    (1, "openssl", "redistributions of any form whatsoever must retain the following acknowledgment", 1.0),
    (1, "openssl", "openssl toolkit", 0.6),
    (1, "ssleay", "cryptographic software written by eric young", 0.9),
    (1, "unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", 1.0),
    (1, "unlicense", "dedicate any and all copyright interest in the software to the public domain", 1.0),
    (1, "beerware", "buy me a beer in return", 1.0),
    (1, "wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document", 0.8),
    (1, "json", "software shall be used for good not evil", 1.0),
    (1, "ijg", "permission is hereby granted to use copy modify and distribute this software or portions thereof for any purpose without fee subject to these conditions", 1.0),
    (1, "unicode", "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files", 1.0),
    (1, "w3c", "permission to copy modify and distribute this (software|work|document) (and its documentation )?with or without modification for any purpose and without fee or royalty", 1.0),
    (1, "ofl-1.1", "reserved font names?", 0.8),
    (1, "ofl-1.1", "licensed under the sil open font license version 1 1", 1.0),
    (1, "blessing", "share freely never taking more than you give", 1.0),
    # Apache
    (1, "apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", 1.0),
    (1, "apache-2.0", "obtain a copy of the license at https? www apache org licenses license 2 0", 1.0),
    (1, "apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license", 1.0),
    (1, "apache-2.0", "contributor license agreements see the notice file distributed with this work", 1.0),
    (1, "apache-2.0", "perpetual worldwide non exclusive no charge royalty free irrevocable (copyright|patent) license", 0.9),
    (1, "apache-1.1", "product includes software developed by the apache software foundation", 0.9),
    (2, "apache-2.0", "apache org licenses license 2 0", 0.9),
    # GNU
    (1, "gpl-1.0-or-later", "either version 1 of the license or at your option any later version", 0.9),
    (1, "gpl-2.0-or-later", "either version 2 of the license or at your option any later version", 1.0),
    (1, "gpl-3.0-or-later", "either version 3 of the license or at your option any later version", 1.0),
    (1, "lgpl-2.1-or-later", "either version 2 1 of the license or at your option any later version", 1.0),
    (1, "gpl-2.0-only", "gnu general public license version 2 as published by the free software foundation", 1.0),
    (1, "gpl-2.0-only", "gnu general public license version 2 only", 1.0),
    (1, "gpl-3.0-only", "gnu general public license version 3 as published by the free software foundation", 1.0),
    (1, "gpl-2.0", "general public license as published by the free software foundation version 2", 1.0),
    (1, "gpl-3.0", "general public license as published by the free software foundation version 3", 1.0),
    (1, "gpl", "copyleft license for software and other kinds of works", 0.9),
    (1, "gpl", "licensed under the (terms of the )?(gnu )?gpl( v?[123]( 0)?)?", 0.9),
    (1, "gpl", "received a copy of the gnu general public license along with", 0.9),
    (1, "lgpl", "received a copy of the gnu (lesser|library) general public license along with", 0.9),
    (1, "agpl", "received a copy of the gnu affero general public license along with", 0.9),
    (1, "agpl-3.0", "remote network interaction use with the gnu general public license", 0.9),
    (1, "gfdl", "invariant sections no front cover texts and no back cover texts .{0,60}?license", 1.0),
    (1, "gfdl", "gnu free documentation license version 1 [123] or any later version", 1.0),
    (2, "gpl-2.0-or-later", "gpl (v|version )?2( 0)? or( any)? later", 0.9),
    (2, "gpl-3.0-or-later", "gpl (v|version )?3( 0)? or( any)? later", 0.9),
    (2, "gpl-2.0", "gpl (v|version )?2( 0)?", 0.8),
    (2, "gpl-3.0", "gpl (v|version )?3( 0)?", 0.8),
    (2, "lgpl-2.1", "lgpl (v|version )?2 1", 0.8),
    (2, "lgpl-3.0", "lgpl (v|version )?3( 0)?", 0.8),
    (2, "agpl-3.0", "agpl (v|version )?3( 0)?", 0.8),
    (3, "gpl", "gpl compatible", 0.4),
    (3, "gpl", "gnu org licenses( gpl)?", 0.6),
    # exceptions to the GNU licenses
    (2, "classpath-exception", "classpath exception", 0.8),
    (1, "classpath-exception", "linking this library statically or dynamically with other modules is making a combined work .{0,60}?license", 1.0),
    (2, "linking-exception", "linking exception( to the)?( gnu)?( lesser)?( general public)? license", 0.8),
    (2, "gcc-exception", "gcc runtime library exception( .{0,40}?license)?", 0.9),
    (1, "autoconf-exception", "autoconf configure script .{0,120}? license", 0.9),
    (1, "bison-exception", "bison parser skeleton .{0,120}? license", 0.9),
    (2, "font-exception", "font exception", 0.7),
    (1, "openssl-exception", "permission to link the code of .{1,80}? with the openssl", 1.0),
    (2, "llvm-exception", "llvm exceptions?( to the apache)?( .{0,30}?license)?", 0.8),
    (1, "linux-syscall-note", "user programs that use kernel services by normal system calls .{0,80}? license", 0.9),
    # Mozilla, Eclipse, Sun and other reciprocal ones
    (1, "mpl-2.0", "source code form is subject to the terms of the mozilla public license v 2 0", 1.0),
    (1, "mpl-1.1", "contents of this file are subject to the mozilla public license version 1 1", 1.0),
    (1, "mpl-1.0", "contents of this file are subject to the mozilla public license version 1 0", 1.0),
    (1, "mpl", "mozilla org mpl", 0.8),
    (1, "netscape-1.1", "contents of this file are subject to the netscape public license", 1.0),
    (1, "eclipse-1.0", "accompanying materials are made available under the terms of the eclipse public license v1( 0)?", 1.0),
    (1, "eclipse-2.0", "accompanying materials are made available under the terms of the eclipse public license v? ?2 0", 1.0),
    (1, "cddl-1.0", "contents of this file are subject to the terms of the common development and distribution license", 1.0),
    (1, "cpl-1.0", "accompanying materials are made available under the terms of the common public license", 1.0),
    (1, "ms-pl", "grants you a non exclusive worldwide royalty free copyright license to reproduce its contribution", 0.9),
    (1, "eupl", "licensed under the eupl( version)?( 1 [12])?", 1.0),
    (1, "apple-psl-2.0", "contains original code and or modifications of original code as defined in and that are subject to the apple public source license", 1.0),
    (1, "artistic-2.0", "artistic license 2 0", 0.9),
    (1, "artistic-or-gpl", "redistribute it and or modify it under the same terms as perl itself", 0.9),
    (1, "ruby", "redistribute it and or modify it under the terms of ruby", 0.9),
    (1, "vim", "vim license", 0.7),
    (1, "osl-3.0", "licensed under the open software license version 3 0", 1.0),
    (1, "sleepycat", "redistributions in any form must be accompanied by information on how to obtain complete source code", 1.0),
    # source-available and restricted ones
    (1, "sspl-1.0", "server side public license( v(ersion)? 1)?", 1.0),
    (1, "busl-1.1", "business source license( 1 1)?", 1.0),
    (1, "elastic-2.0", "elastic license( v?2 0)?", 1.0),
    (2, "commons-clause", "commons clause license condition", 1.0),
    (1, "polyform", "polyform (noncommercial|small business|shield|strict|perimeter|internal use) license", 1.0),
    (1, "openrail", "(openrail|bigscience) (m )?(rail )?license", 0.9),
    (1, "llama", "llama [234]( [123])? community license( agreement)?", 1.0),
    (2, "non-commercial", "non commercial (use|purposes?) only", 0.6),
    (2, "non-commercial", "noncommercial (use|purposes?) only", 0.6),
    (2, "research-only", "research purposes only .{0,60}?licen[cs]e", 0.6),
    (3, "evaluation-only", "evaluation purposes only .{0,60}?licen[cs]e", 0.6),
    (1, "proprietary", "unauthorized (copying|reproduction|use|distribution) .{0,80}?(prohibited|license|copyright)", 0.8),
    (1, "proprietary", "reproduced .{0,60}? without (the )?(prior )?(express )?written permission", 0.8),
    (1, "proprietary", "reproduction in whole or in part (is prohibited )?without (the )?(prior )?(written )?permission", 0.8),
    (1, "proprietary", "confidential and proprietary (information|property|software|to)", 0.7),
    (2, "proprietary", "licensed not sold", 0.7),
    (2, "proprietary", "proprietary license", 0.6),
    (2, "eula", "end user license agreement", 0.8),
    # public domain and Creative Commons beyond the table below
    (1, "cc0-1.0", "cc0 1 0 universal( public domain dedication)?", 1.0),
    (1, "cc0-1.0", "waived all copyright and related or neighboring rights", 1.0),
    (1, "cc0-1.0", "creativecommons org publicdomain zero 1 0", 1.0),
    (1, "pddl-1.0", "public domain dedication and licen[cs]e", 0.9),
    (1, "public-domain", "hereby (placed|released|put) (in|into) the public domain", 0.9),
    (1, "public-domain", "disclaims copyright to this source code", 0.9),
    (1, "public-domain", "public domain mark( 1 0)?", 0.8),
    (2, "us-government", "work of the u s government .{0,60}?(public domain|copyright)", 0.8),
    (2, "cc-by-4.0", "creativecommons org licenses by 4 0", 0.9),
    (2, "cc-by-3.0", "creativecommons org licenses by 3 0", 0.9),
    (2, "cc-by-sa-4.0", "creativecommons org licenses by sa 4 0", 0.9),
    (2, "cc-by-sa-3.0", "creativecommons org licenses by sa 3 0", 0.9),
    (2, "cc-by-nc-4.0", "creativecommons org licenses by nc 4 0", 0.9),
    (2, "cc-by-nc-sa-4.0", "creativecommons org licenses by nc sa 4 0", 0.9),
    (2, "cc-by-nc-nd-4.0", "creativecommons org licenses by nc nd 4 0", 0.9),
    (3, "creative-commons", "creativecommons org( licenses)?", 0.5),
    # Latin-script languages other than English
    (3, "reserved", "tous droits réservés .{0,40}?copyright", 0.5),
    (3, "reserved", "copyright .{0,40}?(tous droits réservés|alle rechte vorbehalten|todos los derechos reservados)", 0.6),
    # disclaimers, references and identifiers
    (2, "no-warranty", "warranties of merchantability fitness for a particular purpose and non ?infringement", 0.6),
    (2, "no-warranty", "warranty of merchantability or fitness for a particular purpose", 0.6),
    (3, "no-warranty", "without warranties or conditions of any kind", 0.5),
    (3, "no-warranty", "absolutely no warranty", 0.5),
    (3, "license-file", "see (the )?(accompanying )?(file )?licen[cs]e( (txt|md|file))? for (more |further )?(details|information|terms)", 0.5),
    (3, "license-file", "license (txt|md|rst)", 0.4),
    (3, "license-file", "copyright and license information", 0.4),
    (3, "license-identifier", "spdx license identifier", 0.5),
    (3, "license-mention", "dual licensed( under)?", 0.5),
    (3, "license-mention", "open source license", 0.4),
    (3, "license-mention", "free software license", 0.4),
    (3, "license-mention", "released under (the|an?) .{1,40}? licen[cs]e", 0.4),
    (3, "copyright", "copyright( c)? by", 0.4),
    (3, "copyright", "copyrighted (material|work|by)", 0.4),
    (3, "copyright", "portions copyright", 0.4),
    (3, "copyright", "copyright holders?", 0.3),
    (3, "copyright", "copyright owners?", 0.3),
)

#: Conditions of Creative Commons licenses: label, short form, long form.
CONDITIONS = (
    ("by", "by", "attribution"),
    ("by-sa", "by sa", "attribution share ?alike"),
    ("by-nc", "by nc", "attribution non ?commercial"),
    ("by-nd", "by nd", "attribution no ?deriv(ative)?s"),
    ("by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
    ("by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(ative)?s"),
)
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

#: (label, phrase) that the scan's contract names; their detections are never suppressed.
BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))

#: Every match of a rule contains one of these in a word; a text without any of them is not looked at.
TRIGGERS = (
    "licen", "copyright", "rights", "domain", "gnu", "gpl", "spdx", "permission", "redistribut", "warrant",
    "creative", "cc0", "proprietary", "wtfpl", "granted", "copying", "openssl", "apache", "mozilla", "unauthorized", "reserved",
    "commercial", "exception", "altered", "misrepresented", "compile", "beer", "evil", "freely", "advertis", "cryptographic", "contributor",
)


def rules() -> list[dict]:
    """All rules in order, each with its keyword and the pattern that starts there."""
    out: list[tuple[int, str, str, float, bool]] = [(1, label, phrase, 0.6, True) for label, phrase in BASE]
    out += [(p, label, text, w, False) for p, label, text, w in TEXTS + NOTICES]
    for label, name, version in LICENSES:
        family = re.sub(r"-[0-9.]+$", "", label)
        licence = "" if name == "unlicense" else " licen[cs]e"
        tail = f"{licence} {_VERSION}{version}" if version else licence
        out += [(1, label, f"{grant} under {_TERMS}{name}{tail}", 1.0, False) for grant in GRANTS]
        out.append((2, label, f"{name}{tail}", 0.9, False))
        if version:
            out.append((3, family, f"{name}{licence}", 0.7, False))
        out.append((1, label, f"spdx license identifier {re.sub('[-.]', ' ', label)}", 1.0, False))
    for label, short, long in CONDITIONS:
        for version in CC_VERSIONS:
            name = f"cc-{label}-{version.replace(' ', '.')}"
            out.append((2, name, f"cc {short} {version}", 0.9, False))
            out.append((2, name, f"creative commons {long} {version}", 0.9, False))
            out.append((1, name, f"licensed under {_TERMS}(a )?(cc {short}|creative commons {long}) {_VERSION}{version}", 1.0, False))
        out.append((3, f"cc-{label}", f"cc {short}", 0.6, False))
        out.append((3, f"cc-{label}", f"creative commons {long}", 0.7, False))
    table = []
    for priority, label, text, weight, base in out:
        first = re.match(r"[a-z0-9]+(?= |$|\()", text)
        if first:  # a plain first word; an optional letter or choice there is written out by rows below
            table.append((priority, label, first[0], text, weight, base))
        else:
            options = _first_words(text)
            table += [(priority, label, word, text, weight, base) for word in options]
    names = ("priority", "label", "keyword", "pattern", "weight", "base")
    return [{"id": i} | dict(zip(names, (p, lab, k, f"^{t}( |$)", w, b))) for i, (p, lab, k, t, w, b) in enumerate(table)]


def _first_words(text: str) -> list[str]:
    """The words that a pattern can start with when its first word has a choice."""
    if m := re.match(r"\(([a-z|]+)\)", text):
        return m[1].split("|")
    if m := re.match(r"([a-z]+)([a-z])\?", text):
        return [m[1], m[1] + m[2]]
    raise ValueError(text)
