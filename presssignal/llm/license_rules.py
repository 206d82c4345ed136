"""Ordered signature rules for license scans; earlier rules have priority.

A rule is a label, a weight, keywords that all must stand in the lower-cased text, and a pattern. Of a
keyword with bars one part must; whatever a pattern matches has its keywords. In patterns and keywords
a blank stands for any run of blanks, line ends and comment marks.
"""

from __future__ import annotations

from dataclasses import dataclass

# Clauses that only one license (family) has: label, keywords, pattern.
CLAUSES = [
    ("mit", "permission is hereby", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "substantial portions", r"the above copyright notice and this permission notice (?:\(including the next paragraph\) )?shall be included in all copies or substantial portions"),
    ("mit-0", "deal in the software", r"to deal in the software without restriction, including without limitation the rights .{0,200}to do so\. the software is provided"),
    ("x11", "x consortium", r"except as contained in this notice, the name of the x consortium shall not be used in advertising"),
    ("isc", "with or without fee", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted, provided that the above"),
    ("0bsd", "with or without fee", r"permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted\. the software"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd-3-clause", "endorse or promote", r"neither the names? of .{1,120}? nor the names of (?:its|any) contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-2-clause", "views and conclusions", r"the views and conclusions contained in the software and documentation are those of the authors"),
    ("bsd-clear", "patent rights are granted", r"no express or implied licenses to any party's patent rights are granted by this license"),
    ("apache-2.0", "apache license", r"licensed under the apache license, version 2(?:\.0)?"),
    ("apache-2.0", "applicable law", r"unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an \S?as is\S? basis"),
    ("apache-1.1", "apache software foundation", r"this product includes software developed by the apache software foundation"),
    ("gpl", "gnu general public", r"you can redistribute it and/or modify it under the terms of the gnu general public license"),
    ("gpl-2.0-or-later", "any later version", r"either version 2 of the license, or \(?at your option\)? any later version"),
    ("gpl-3.0-or-later", "any later version", r"either version 3 of the license, or \(?at your option\)? any later version"),
    ("gpl", "without any warranty", r"distributed in the hope that it will be useful, but without any warranty"),
    ("gpl", "write to the free software", r"if not, write to the free software foundation"),
    ("gpl", "along with this", r"you should have received a copy of the gnu general public license along with this (?:program|file|library)"),
    ("lgpl", "lesser general", r"under the terms of the gnu lesser general public license"),
    ("lgpl", "library general", r"under the terms of the gnu library general public license"),
    ("agpl", "affero", r"under the terms of the gnu affero general public license"),
    ("gfdl", "documentation license", r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2.0", "mozilla public", r"this source code form is subject to the terms of the mozilla public license, v\. ?2\.0"),
    ("mpl-1.1", "mozilla public", r"the contents of this file are subject to the mozilla public license version 1\.1"),
    ("npl", "netscape public", r"the contents of this file are subject to the netscape public license"),
    ("epl", "eclipse public", r"made available under the terms of the eclipse public license"),
    ("cddl", "common development", r"subject to the terms of the common development and distribution license"),
    ("cpl", "common public", r"made available under the terms of the common public license"),
    ("zlib", "origin of this software", r"the origin of this software must not be misrepresented"),
    ("zlib", "plainly marked", r"altered source versions must be plainly marked as such"),
    ("bsl-1.0", "boost software", r"distributed under the boost software license"),
    ("unlicense", "public domain", r"this is free and unencumbered software released into the public domain"),
    ("cc0-1.0", "neighboring rights", r"waived all copyright and related or neighboring rights"),
    ("wtfpl", "want to public", r"do what the f\S{3} you want to public license"),
    ("artistic", "perl itself|artistic license", r"under the (?:same )?terms (?:as|of) perl itself|under the terms of the artistic license"),
    ("perl", "terms as perl", r"you (?:can|may) redistribute it and/or modify it under the same terms as perl"),
    ("python", "psf is making", r"psf is making python available to licensee on an \S?as is\S? basis"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project"),
    ("ofl-1.1", "open font", r"this font software is licensed under the sil open font license"),
    ("ofl-1.1", "reserved font", r"no modified version of the font software may use the reserved font name"),
    ("postgresql", "without a written agreement", r"for any purpose, without fee, and without a written agreement is hereby granted"),
    ("curl", "copyright holder shall not", r"except as contained in this notice, the name of a copyright holder shall not be used in advertising"),
    ("json", "for good, not evil", r"the software shall be used for good, not evil"),
    ("beerware", "buy me a beer", r"you can buy me a beer in return"),
    ("vim", "vim", r"vim is charityware"),
    ("sspl-1.0", "server side public", r"under the terms of the server side public license, version 1"),
    ("busl-1.1", "business source", r"use of this software is governed by the business source license"),
    ("elastic-2.0", "elastic license", r"licensed under the elastic license 2\.0|subject to the elastic license"),
    ("commons-clause", "right to sell|commons clause", r"the license does not grant to you, the right to sell the software|commons clause license condition"),
    ("ms-pl", "microsoft public", r"licensed under the microsoft public license"),
    ("public-domain", "public domain", r"(?:is|are|been) (?:hereby )?(?:placed|released|put|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", "copyright is claimed|public domain", r"no copyright is claimed|in the public domain in the united states"),
    ("proprietary", "all rights reserved", r"all rights reserved\.? (?:unauthorized|no part of)"),
    ("proprietary", "proprietary and confidential", r"proprietary and confidential"),
    ("cc", "creative commons", r"this work is licensed under a creative commons"),
]

# Licenses by name: label, keyword of the name, name, identifier, keyword and pattern of an address.
NAMED = [
    ("mit", "mit", r"(?:the )?mit(?:/x11)?", r"mit", "license/mit|licenses/mit", r"opensource\.org/licenses?/mit"),
    ("apache-2.0", "apache", r"apache(?: software)? licen[cs]e,? ?(?:v|version)? ?2(?:\.0)?", r"apache-2\.0", "licenses/license-2.0", r"apache\.org/licenses/license-2\.0"),
    ("apache", "apache", r"apache(?: software)?", r"apache-1\.[01]", "apache.org/licenses", r"apache\.org/licenses"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public licen[cs]e,? ?(?:v|version)? ?3", r"agpl-3\.0(?:-only|-or-later|\+)?", "licenses/agpl", r"gnu\.org/licenses/agpl"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public licen[cs]e,? ?(?:v|version)? ?2\.1", r"lgpl-2\.1(?:-only|-or-later|\+)?", "lgpl-2.1", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-3.0", "lesser", r"(?:gnu )?lesser general public licen[cs]e,? ?(?:v|version)? ?3", r"lgpl-3\.0(?:-only|-or-later|\+)?", "licenses/lgpl", r"gnu\.org/licenses/lgpl"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl(?:v[23](?:\.[01])?)?", r"lgpl-2\.0(?:-only|-or-later|\+)?", "copyleft/lesser", r"gnu\.org/copyleft/lesser"),
    ("gpl-2.0", "general public", r"(?:gnu )?general public licen[cs]e,? ?(?:v|version)? ?2", r"gpl-2\.0(?:-only|-or-later|\+)?", "gpl-2.0", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("gpl-3.0", "general public", r"(?:gnu )?general public licen[cs]e,? ?(?:v|version)? ?3", r"gpl-3\.0(?:-only|-or-later|\+)?", "licenses/gpl", r"gnu\.org/licenses/gpl"),
    ("gpl", "gpl", r"(?:gnu )?gpl(?:v[23])?", r"gpl-1\.0(?:-only|-or-later|\+)?", "copyleft/gpl", r"gnu\.org/copyleft/gpl"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation", r"gfdl-1\.[123](?:-only|-or-later)?", "licenses/fdl", r"gnu\.org/licenses/fdl"),
    ("bsd-2-clause", "bsd", r"(?:2-clause|simplified|freebsd) bsd|bsd 2-clause", r"bsd-2-clause", "license/bsd-2|licenses/bsd-2", r"opensource\.org/licenses?/bsd-2"),
    ("bsd-3-clause", "bsd", r"(?:3-clause|new|modified|revised) bsd|bsd 3-clause", r"bsd-3-clause", "license/bsd-3|licenses/bsd-3", r"opensource\.org/licenses?/bsd-3"),
    ("bsd-4-clause", "bsd", r"(?:4-clause|original) bsd|bsd 4-clause", r"bsd-4-clause", "bsd-4-clause", r"spdx\.org/licenses/bsd-4-clause"),
    ("bsd", "bsd", r"bsd(?:-style)?", r"bsd", "license/bsd-license|licenses/bsd-license", r"opensource\.org/licenses?/bsd-license"),
    ("0bsd", "zero-clause", r"(?:bsd )?zero-clause(?: bsd)?", r"0bsd", "license/0bsd|licenses/0bsd", r"opensource\.org/licenses?/0bsd"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[cs]e,? ?(?:v|version)? ?2(?:\.0)?", r"mpl-2\.0", "mpl/2", r"mozilla\.org/(?:en-us/)?mpl/2"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e,? ?(?:v|version)? ?1\.1", r"mpl-1\.1", "mozilla.org/mpl", r"mozilla\.org/mpl/1|mozilla\.org/mpl/mpl-1"),
    ("mpl", "mozilla public", r"mozilla public", r"mpl-1\.0", "mozilla.org/mpl", r"mozilla\.org/mpl"),
    ("epl-2.0", "eclipse", r"eclipse public licen[cs]e,? ?-? ?(?:v|version)? ?2(?:\.0)?", r"epl-2\.0", "epl-2.0", r"eclipse\.org/legal/epl-2\.0"),
    ("epl-1.0", "eclipse", r"eclipse public licen[cs]e,? ?-? ?(?:v|version)? ?1(?:\.0)?", r"epl-1\.0", "epl-v10", r"eclipse\.org/legal/epl-v10"),
    ("edl-1.0", "eclipse distribution", r"eclipse distribution", r"edl-1\.0", "edl-v10", r"eclipse\.org/org/documents/edl-v10"),
    ("cddl-1.0", "common development", r"common development and distribution", r"cddl-1\.[01]", "license/cddl|licenses/cddl", r"opensource\.org/licenses?/cddl"),
    ("cpl-1.0", "common public", r"common public", r"cpl-1\.0", "license/cpl|licenses/cpl", r"opensource\.org/licenses?/cpl"),
    ("ipl-1.0", "ibm public", r"ibm public", r"ipl-1\.0", "license/ibmpl|licenses/ibmpl", r"opensource\.org/licenses?/ibmpl"),
    ("isc", "isc", r"(?:the )?isc", r"isc", "license/isc|licenses/isc", r"opensource\.org/licenses?/isc"),
    ("zlib", "zlib", r"zlib(?:/libpng)?", r"zlib", "license/zlib|licenses/zlib", r"opensource\.org/licenses?/zlib"),
    ("libpng", "libpng", r"libpng", r"libpng(?:-2\.0)?", "libpng-license", r"libpng\.org/pub/png/src/libpng-license"),
    ("bsl-1.0", "boost", r"boost software", r"bsl-1\.0", "license_1_0", r"boost\.org/license_1_0"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", r"unlicense", "unlicense.org", r"unlicense\.org"),
    ("wtfpl", "wtfpl", r"wtfpl", r"wtfpl", "wtfpl.net", r"wtfpl\.net"),
    ("artistic-2.0", "artistic", r"artistic licen[cs]e,? ?(?:v|version)? ?2(?:\.0)?", r"artistic-2\.0", "artistic_license_2", r"perlfoundation\.org/artistic_license_2"),
    ("artistic", "artistic", r"(?:perl )?artistic", r"artistic-1\.0(?:-perl|-cl8)?", "license/artistic|licenses/artistic", r"opensource\.org/licenses?/artistic"),
    ("python", "python", r"python(?: software foundation)?", r"(?:psf|python)-2\.0", "docs.python.org", r"docs\.python\.org/\S*license"),
    ("ruby", "ruby", r"ruby", r"ruby", "ruby-lang.org", r"ruby-lang\.org/\S*license"),
    ("php", "php", r"php", r"php-3\.0[1]?", "php.net/license", r"php\.net/license"),
    ("zpl", "zope", r"zope public", r"zpl-[12]\.[01]", "license/zpl|licenses/zpl", r"opensource\.org/licenses?/zpl"),
    ("openssl", "openssl", r"openssl", r"openssl", "openssl.org/source/license", r"openssl\.org/source/license"),
    ("ofl-1.1", "open font", r"(?:sil )?open font", r"ofl-1\.1", "scripts.sil.org/ofl", r"scripts\.sil\.org/ofl"),
    ("postgresql", "postgresql", r"postgresql", r"postgresql", "postgresql.org/about/licence", r"postgresql\.org/about/licence"),
    ("ncsa", "ncsa", r"(?:university of illinois/?)?ncsa(?: open source)?", r"ncsa", "license/ncsa|licenses/ncsa", r"opensource\.org/licenses?/ncsa"),
    ("afl-3.0", "academic free", r"academic free", r"afl-[123]\.[01]", "license/afl|licenses/afl", r"opensource\.org/licenses?/afl"),
    ("osl-3.0", "open software", r"open software", r"osl-[123]\.[01]", "license/osl|licenses/osl", r"opensource\.org/licenses?/osl"),
    ("eupl-1.2", "european union", r"european union public", r"eupl-1\.[012]", "eupl", r"joinup\.ec\.europa\.eu/\S*eupl"),
    ("cecill", "cecill", r"cecill(?:-[bc])?", r"cecill-(?:[12]\.[01]|[bc])", "cecill.info", r"cecill\.info"),
    ("mulan", "mulan", r"mulan (?:permissive|public)(?: software)?", r"mulanpsl-[12]\.0", "license.coscl.org", r"license\.coscl\.org\.cn"),
    ("ms-pl", "microsoft public", r"microsoft public", r"ms-pl", "license/ms-pl|licenses/ms-pl", r"opensource\.org/licenses?/ms-pl"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal", r"ms-rl", "license/ms-rl|licenses/ms-rl", r"opensource\.org/licenses?/ms-rl"),
    ("upl-1.0", "universal permissive", r"universal permissive", r"upl-1\.0", "license/upl|licenses/upl", r"(?:opensource\.org|oss\.oracle\.com)/licenses?/upl"),
    ("sspl-1.0", "server side", r"server side public", r"sspl-1\.0", "server-side-public-license", r"mongodb\.com/licensing/server-side-public-license"),
    ("busl-1.1", "business source", r"business source", r"busl-1\.1", "mariadb.com/bsl11", r"mariadb\.com/bsl11"),
    ("elastic-2.0", "elastic", r"elastic", r"elastic-2\.0", "elastic.co/licensing", r"elastic\.co/licensing"),
    ("vim", "vim", r"vim", r"vim", "uganda.html", r"vimdoc\.sourceforge\.net/\S*uganda\.html"),
    ("hpnd", "historical permission", r"historical permission notice", r"hpnd", "license/hpnd|licenses/hpnd", r"opensource\.org/licenses?/hpnd"),
    ("ecl-2.0", "educational community", r"educational community", r"ecl-[12]\.0", "license/ecl|licenses/ecl", r"opensource\.org/licenses?/ecl"),
    ("lppl", "latex project", r"latex project public", r"lppl-1\.[0-3][ac]?", "lppl", r"latex-project\.org/lppl"),
    ("cc0-1.0", "cc0|cc zero", r"(?:creative commons )?(?:cc0|cc zero)", r"cc0-1\.0", "publicdomain/zero", r"creativecommons\.org/publicdomain/zero"),
    ("cc-by-nc-nd", "noncommercial", r"creative commons attribution-noncommercial-noderiv(?:ative)?s?", r"cc-by-nc-nd-[1-4]\.[05]", "licenses/by-nc-nd", r"creativecommons\.org/licenses/by-nc-nd"),
    ("cc-by-nc-sa", "noncommercial", r"creative commons attribution-noncommercial-sharealike", r"cc-by-nc-sa-[1-4]\.[05]", "licenses/by-nc-sa", r"creativecommons\.org/licenses/by-nc-sa"),
    ("cc-by-nc", "noncommercial", r"creative commons attribution-noncommercial", r"cc-by-nc-[1-4]\.[05]", "licenses/by-nc", r"creativecommons\.org/licenses/by-nc"),
    ("cc-by-nd", "noderiv", r"creative commons attribution-noderiv(?:ative)?s?", r"cc-by-nd-[1-4]\.[05]", "licenses/by-nd", r"creativecommons\.org/licenses/by-nd"),
    ("cc-by-sa", "sharealike", r"creative commons attribution-sharealike", r"cc-by-sa-[1-4]\.[05]", "licenses/by-sa", r"creativecommons\.org/licenses/by-sa"),
    ("cc-by", "creative commons", r"creative commons attribution", r"cc-by-[1-4]\.[05]", "licenses/by/", r"creativecommons\.org/licenses/by/"),
    ("odbl", "open database", r"open database", r"odbl-1\.0", "licenses/odbl", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by", "data commons", r"open data commons attribution", r"odc-by-1\.0", "opendatacommons.org/licenses/by", r"opendatacommons\.org/licenses/by"),
    ("ogl", "open government", r"open government", r"ogl-uk-[123]\.0", "open-government-licence", r"nationalarchives\.gov\.uk/doc/open-government-licence"),
]


@dataclass(frozen=True)
class Rule:
    label: str
    weight: float
    keywords: tuple[str, ...]
    pattern: str


def rules() -> list[Rule]:
    """All rules in the order of their priority: tags, clauses, addresses, notices, bare names."""
    tags = [Rule(n[0], 0.98, ("spdx",), rf"spdx-license-identifier: \(?{n[3]}(?![\w.+-])") for n in NAMED]
    clauses = [Rule(label, 0.95, (key,), pattern) for label, key, pattern in CLAUSES]
    addresses = [Rule(n[0], 0.85, (n[4],), n[5]) for n in NAMED]
    notices = [
        Rule(n[0], 0.9, (n[1], "under"), rf"\b(?:licen[cs]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of )?(?:the )?(?:{n[2]})\b")
        for n in NAMED
    ]
    names = [
        Rule(n[0], 0.6, (n[1], "licen"), rf"\b(?:{n[2]})" + (r"\b" if "licen" in n[2] else r" (?:public )?licen[cs]e\b"))
        for n in NAMED
    ]
    return tags + clauses + addresses + notices + names
