"""Signatures of licences: hand-written patterns over lower-case text, most telling first.

A space stands for any white space. Groups are in order of priority, and so are
the signatures in a group.
"""

#: Sentences of licence texts and of the notices that they ask for.
TEXTS = (
    ("mit", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("mit", r"without restriction, including without limitation the rights to use, copy, modify, merge, publish"),
    ("x11", r"except as contained in this notice, the names? of .{1,80}? shall not be used in advertising"),
    ("json", r"the software shall be used for good, not evil"),
    ("isc", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee"),
    ("hpnd", r"permission to use, copy, modify,? and distribute this software and its documentation for any purpose"),
    ("postgresql", r"documentation for any purpose, without fee, and without a written agreement is hereby granted"),
    ("bsd", r"redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", r"neither the names? of .{1,80}? nor the names of (?:its|their) contributors may be used to endorse"),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display"),
    ("bsd", r"any express(?:ed)? or implied warranties, including, but not limited to, the implied warranties of merchantability"),
    ("zlib", r"this software is provided ['‘]as-is['’], without any express or implied warranty"),
    ("zlib", r"the origin of this software must not be misrepresented"),
    ("zlib", r"altered source versions must be plainly marked as such"),
    ("bsl-1.0", r"to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("bsl-1.0", r"machine-executable object code generated by a source language processor"),
    ("apache-2.0", r"licensed under the apache license, version 2\.0"),
    ("apache-2.0", r"unless required by applicable law or agreed to in writing, software distributed under the license"),
    ("apache-2.0", r"terms and conditions for use, reproduction, and distribution"),
    ("apache-2.0", r"grant of patent license\. subject to the terms and conditions of this license"),
    ("apache-1.1", r"this product includes software developed by the apache software foundation"),
    ("lgpl", r"this library is free software[;:,] you can redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("lgpl", r"the (?:lesser|library) general public license,? applies to some (?:specially )?designated"),
    ("agpl", r"under the terms of the gnu affero general public license"),
    ("agpl", r"you should have received a copy of the gnu affero general public license"),
    ("agpl", r"remote network interaction; use with the gnu general public license"),
    ("gpl", r"this program is free software[;:,] you can redistribute it and/or modify it under the terms of the gnu general public license"),
    ("gpl", r"you should have received a copy of the gnu general public license"),
    ("gpl", r"everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("gpl", r"the licenses for most software are designed to take away your freedom"),
    ("gpl", r"this program comes with absolutely no warranty"),
    ("gpl-exception", r"as a special exception,? .{1,80}? gives? (?:you )?(?:unlimited )?permission to (?:link|copy)"),
    ("classpath-exception", r"linking this library statically or dynamically with other modules is making a combined work"),
    ("gfdl", r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", r"no invariant sections, (?:with )?no front-cover texts"),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license"),
    ("mpl-2.0", r"if a copy of the mpl was not distributed with this file, you can obtain one at"),
    ("mpl-2.0", r"incompatible with secondary licenses"),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public license"),
    ("npl", r"the contents of this file are subject to the netscape public license"),
    ("cddl", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("epl", r"accompanying materials are made available under the terms of the eclipse public license"),
    ("edl", r"accompanying materials are made available under the terms of the eclipse distribution license"),
    ("epl", r"the accompanying program is provided under the terms of this eclipse public license"),
    ("cpl", r"the accompanying program is provided under the terms of this common public license"),
    ("ipl", r"the accompanying program is provided under the terms of this ibm public license"),
    ("eupl", r"licensed under the eupl"),
    ("eupl", r"this european union public licence .{0,40}?applies to the work"),
    ("artistic-1.0", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", r"this license establishes the terms under which a given free software package may be copied"),
    ("perl", r"under the same terms as (?:the )?perl (?:itself|programming language|5)"),
    ("psf", r"psf hereby grants licensee a nonexclusive, royalty-free, world-?wide license"),
    ("psf", r"this license agreement is between the python software foundation"),
    ("php", r"this product includes php(?: software)?, freely available from"),
    ("php", r"this source file is subject to version [0-9.]+ of the php license"),
    ("ruby", r"modify it under either the terms of the (?:2-clause bsdl|gpl)"),
    ("openssl", r"this product includes software developed by the openssl project"),
    ("ssleay", r"this product includes cryptographic software written by eric young"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", r"anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("wtfpl", r"you just do what the \w+ you want to"),
    ("beerware", r"as long as you retain this notice you can do whatever you want with this stuff"),
    ("cc0", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0", r"has waived all copyright and related or neighbou?ring rights"),
    ("cc0", r"affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives"),
    ("cc", r"you accept and agree to be bound by the terms and conditions of this creative commons"),
    ("ofl", r"this font software is licensed under the sil open font license"),
    ("ofl", r"the font software, modified or unmodified, in part or in whole, must be distributed entirely under this license"),
    ("odbl", r"is made available under the open database licen[sc]e"),
    ("sspl", r"make the functionality of the program or a modified version available to third parties as a service"),
    ("busl", r"redistribute, and make non-production use of the licensed work"),
    ("elastic", r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", r"the grant of rights under the license will not include, and the license does not grant to you, the right to sell the software"),
    ("ms-pl", r"this license governs use of the accompanying software\. if you use the software, you accept this license"),
    ("ms-rl", r"for any file you distribute that contains code from the software"),
    ("unicode", r"any person obtaining a copy of the unicode data files"),
    ("ijg", r"this software is based in part on the work of the independent jpeg group"),
    ("libpng", r"the png reference library is supplied [\"“]?as is"),
    ("ftl", r"portions of this software are copyright .{1,40}? the freetype project"),
    ("tcl", r"the authors hereby grant permission to use, copy, modify, distribute, and license this software"),
    ("vim", r"vim is charityware"),
    ("sleepycat", r"redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("cecill", r"this software is governed by the cecill(?:-[abc])? licen[sc]e"),
    ("cecill", r"ce logiciel est r[ée]gi par la licence cecill"),
    ("w3c", r"this work is being provided by the copyright holders under the following license"),
    ("ncsa", r"to deal with the software without restriction, including without limitation"),
    ("upl", r"any person obtaining a copy of this software, associated documentation and/or data"),
    ("blueoak", r"no contributor can revoke this license"),
)

#: How users state a licence in prose.
NOTICES = (
    ("agpl", r"(?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?(?:agpl|affero general public licen[sc]e)(?:,? v(?:ersion )?[0-9.]+)?"),
    ("lgpl", r"(?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?(?:lgpl|(?:lesser|library) general public licen[sc]e)(?:,? v(?:ersion )?[0-9.]+)?"),
    ("gpl", r"(?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?(?:gpl|general public licen[sc]e)(?:,? v(?:ersion )?[0-9.]+)?"),
    ("apache", r"(?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?apache(?: software)? (?:2(?:\.0)?|licen[sc]e)(?:,? (?:v|version )?[0-9.]+)?"),
    ("mit", r"(?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:mit|expat)(?: licen[sc]e)?"),
    ("bsd", r"(?:licen[sc]ed|released|distributed|available) under (?:a |the )?(?:terms of (?:the )?)?(?:[23]-clause |new |modified |simplified )?bsd(?:-style)?(?: licen[sc]e)?"),
    ("isc", r"(?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?isc licen[sc]e"),
    ("mpl", r"(?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:mpl|mozilla public licen[sc]e)(?:,? (?:v|version )?[0-9.]+)?"),
    ("epl", r"(?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:epl|eclipse public licen[sc]e)(?:,? (?:v|version )?[0-9.]+)?"),
    ("cddl", r"(?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?cddl(?:[ -][0-9.]+)?"),
    ("zlib", r"(?:licen[sc]ed|released|distributed|available) under (?:the )?zlib(?:/libpng)? licen[sc]e"),
    ("bsl-1.0", r"distributed under the boost software licen[sc]e(?:, version 1\.0)?"),
    ("cc0", r"(?:licen[sc]ed|released|dedicated|available) (?:under|via) (?:the )?(?:creative commons zero|cc0)(?: 1\.0)?(?: universal)?"),
    ("cc-by-nc-nd", r"(?:licen[sc]ed|released|shared|available) under (?:a |the )?(?:creative commons|cc) (?:by|attribution)[ -](?:nc|non-?commercial)[ -](?:nd|no-?deriv\w*)(?: [0-9.]+)?"),
    ("cc-by-nc-sa", r"(?:licen[sc]ed|released|shared|available) under (?:a |the )?(?:creative commons|cc) (?:by|attribution)[ -](?:nc|non-?commercial)[ -](?:sa|share-?alike)(?: [0-9.]+)?"),
    ("cc-by-nc", r"(?:licen[sc]ed|released|shared|available) under (?:a |the )?(?:creative commons|cc) (?:by|attribution)[ -](?:nc|non-?commercial)(?: [0-9.]+)?"),
    ("cc-by-nd", r"(?:licen[sc]ed|released|shared|available) under (?:a |the )?(?:creative commons|cc) (?:by|attribution)[ -](?:nd|no-?deriv\w*)(?: [0-9.]+)?"),
    ("cc-by-sa", r"(?:licen[sc]ed|released|shared|available) under (?:a |the )?(?:creative commons|cc) (?:by|attribution)[ -](?:sa|share-?alike)(?: [0-9.]+)?"),
    ("cc-by", r"(?:licen[sc]ed|released|shared|available) under (?:a |the )?(?:creative commons|cc) (?:by|attribution)(?: [0-9.]+)?"),
    ("public-domain", r"(?:dedicated to|released (?:in)?to|placed (?:in)?to|placed in) the public domain"),
    ("public-domain", r"no copyright (?:is )?(?:claimed|reserved)"),
    ("artistic", r"(?:licen[sc]ed|released|distributed|available) under (?:the )?artistic licen[sc]e(?: 2\.0)?"),
    ("unlicense", r"(?:licen[sc]ed|released|distributed|available) under (?:the )?unlicen[sc]e"),
    ("wtfpl", r"(?:licen[sc]ed|released|distributed|available) under (?:the )?wtfpl"),
    ("dual", r"dual[- ]licen[sc]ed under (?:the )?[\w.+-]+ (?:and|or) (?:the )?[\w.+-]+"),
    ("see-file", r"see (?:the )?(?:accompanying )?(?:file )?(?:licen[sc]e|copying)(?:\.txt|\.md)? (?:file )?(?:for|in) (?:more |further |full |licen[sc]e |licensing )?(?:details|information|terms|the root)"),
    ("proprietary", r"proprietary and confidential"),
    ("proprietary", r"confidential and proprietary"),
    ("proprietary", r"unauthori[sz]ed (?:copying|use|reproduction|distribution) (?:of this \w+)?"),
    ("proprietary", r"no part of this \w+ may be (?:reproduced|copied|used|distributed)"),
    ("proprietary", r"may not be (?:used, )?copied,? (?:or )?(?:modified,? or )?distributed without (?:the )?(?:express|prior|written) "),
    ("proprietary", r"for internal use only"),
    ("proprietary", r"end[- ]user licen[sc]e agreement"),
    ("proprietary", r"all rights reserved"),
)

#: Identifiers, as in headers and in the metadata of packages.
IDS = (
    ("spdx", r"spdx-license-identifier: *\(?[\w.+-]+(?: (?:and|or|with) [\w.+-]+)*"),
    ("spdx", r"spdx-licenselist-?version: *[\w.]+"),
    ("agpl", r"agpl-?v?[0-9](?:\.[0-9]+)?(?:-only|-or-later|\+)?"),
    ("lgpl", r"lgpl-?v?[0-9](?:\.[0-9]+)?(?:-only|-or-later|\+)?"),
    ("gpl", r"gpl-?v?[0-9](?:\.[0-9]+)?(?:-only|-or-later|\+)?"),
    ("gfdl", r"gfdl-1\.[0-9](?:-only|-or-later)?"),
    ("apache-2.0", r"apache-2\.0"),
    ("apache-1.1", r"apache-1\.1"),
    ("bsd-2-clause", r"bsd-2-clause(?:-patent|-views)?"),
    ("bsd-3-clause", r"bsd-3-clause(?:-clear|-lbnl)?"),
    ("bsd-4-clause", r"bsd-4-clause(?:-uc)?"),
    ("0bsd", r"0bsd"),
    ("mpl-2.0", r"mpl-?2\.0"),
    ("mpl-1.1", r"mpl-?1\.[01]"),
    ("epl", r"epl-[12]\.0"),
    ("eupl", r"eupl-1\.[012]"),
    ("cddl", r"cddl-1\.[01]"),
    ("cc0", r"cc0(?:-1\.0| 1\.0)?"),
    ("cc-by-nc-nd", r"cc-by-nc-nd-[0-9.]+"),
    ("cc-by-nc-sa", r"cc-by-nc-sa-[0-9.]+"),
    ("cc-by-nc", r"cc-by-nc-[0-9.]+"),
    ("cc-by-nd", r"cc-by-nd-[0-9.]+"),
    ("cc-by-sa", r"cc-by-sa-[0-9.]+"),
    ("cc-by", r"cc-by-[0-9.]+"),
    ("ofl", r"ofl-1\.[01](?:-rfn|-no-rfn)?"),
    ("odbl", r"odbl-1\.0"),
    ("odc-by", r"odc-by-1\.0"),
    ("pddl", r"pddl-1\.0"),
    ("bsl-1.0", r"bsl-1\.0"),
    ("busl", r"busl-1\.1"),
    ("sspl", r"sspl-1\.0"),
    ("artistic", r"artistic-[12]\.0(?:-perl|-cl8)?"),
    ("afl", r"afl-[123]\.[01]"),
    ("osl", r"osl-[123]\.[01]"),
    ("ecl", r"ecl-[12]\.0"),
    ("ms-pl", r"ms-pl"),
    ("ms-rl", r"ms-rl"),
    ("psf", r"psf-2\.0|python-2\.0"),
    ("php", r"php-3\.01?"),
    ("upl", r"upl-1\.0"),
    ("zpl", r"zpl-[12]\.[01]"),
    ("unicode", r"unicode-(?:dfs-201[56]|3\.0|tou)"),
    ("mit", r"licen[sc]e[\"']? *[:=] *[\[\"'( ]*mit"),
    ("bsd", r"licen[sc]e[\"']? *[:=] *[\[\"'( ]*bsd"),
    ("isc", r"licen[sc]e[\"']? *[:=] *[\[\"'( ]*isc"),
    ("apache", r"licen[sc]e[\"']? *[:=] *[\[\"'( ]*apache"),
    ("gpl", r"licen[sc]e[\"']? *[:=] *[\[\"'( ]*gpl"),
    ("lgpl", r"licen[sc]e[\"']? *[:=] *[\[\"'( ]*lgpl"),
    ("mpl", r"licen[sc]e[\"']? *[:=] *[\[\"'( ]*mpl"),
    ("unlicense", r"licen[sc]e[\"']? *[:=] *[\[\"'( ]*unlicense"),
    ("proprietary", r"licen[sc]e[\"']? *[:=] *[\[\"'( ]*(?:proprietary|commercial|unlicensed)"),
    ("mit", r"license :: osi approved :: mit"),
    ("bsd", r"license :: osi approved :: bsd"),
    ("apache", r"license :: osi approved :: apache"),
    ("gpl", r"license :: osi approved :: gnu general public"),
    ("lgpl", r"license :: osi approved :: gnu lesser general public"),
    ("mpl", r"license :: osi approved :: mozilla public"),
    ("proprietary", r"license :: other/proprietary"),
    ("public-domain", r"license :: public domain"),
)

#: Addresses of licence texts.
LINKS = (
    ("mit", r"opensource\.org/licen[sc]es?/mit(?:-license)?"),
    ("bsd-2-clause", r"opensource\.org/licen[sc]es?/bsd-2-clause"),
    ("bsd-3-clause", r"opensource\.org/licen[sc]es?/bsd-3-clause"),
    ("bsd", r"opensource\.org/licen[sc]es?/bsd-license"),
    ("isc", r"opensource\.org/licen[sc]es?/isc"),
    ("upl", r"opensource\.org/licen[sc]es?/upl"),
    ("cddl", r"opensource\.org/licen[sc]es?/cddl"),
    ("artistic", r"opensource\.org/licen[sc]es?/artistic"),
    ("apache-2.0", r"apache\.org/licenses/license-2\.0"),
    ("apache-1.1", r"apache\.org/licenses/license-1\.1"),
    ("lgpl", r"gnu\.org/(?:copyleft|licenses)/(?:old-licenses/)?lgpl"),
    ("agpl", r"gnu\.org/licenses/agpl"),
    ("gfdl", r"gnu\.org/(?:copyleft|licenses)/fdl"),
    ("gpl", r"gnu\.org/(?:copyleft|licenses)/(?:old-licenses/)?gpl"),
    ("gpl", r"gnu\.org/licenses"),
    ("mpl", r"mozilla\.org/(?:en-us/)?mpl"),
    ("epl", r"eclipse\.org/legal/epl"),
    ("edl", r"eclipse\.org/org/documents/edl"),
    ("cc-by-nc-nd", r"creativecommons\.org/licenses/by-nc-nd"),
    ("cc-by-nc-sa", r"creativecommons\.org/licenses/by-nc-sa"),
    ("cc-by-nc", r"creativecommons\.org/licenses/by-nc"),
    ("cc-by-nd", r"creativecommons\.org/licenses/by-nd"),
    ("cc-by-sa", r"creativecommons\.org/licenses/by-sa"),
    ("cc-by", r"creativecommons\.org/licenses/by"),
    ("cc0", r"creativecommons\.org/publicdomain/zero"),
    ("public-domain", r"creativecommons\.org/publicdomain/mark"),
    ("ofl", r"(?:scripts\.sil\.org|openfontlicense\.org)(?:/ofl)?"),
    ("odbl", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by", r"opendatacommons\.org/licenses/by"),
    ("pddl", r"opendatacommons\.org/licenses/pddl"),
    ("bsl-1.0", r"boost\.org/license_1_0\.txt"),
    ("unlicense", r"unlicense\.org"),
    ("wtfpl", r"wtfpl\.net"),
    ("busl", r"mariadb\.com/bsl11"),
    ("sspl", r"mongodb\.com/licensing/server-side-public-license"),
    ("php", r"php\.net/license"),
    ("psf", r"python\.org/(?:psf/license|download/releases/[0-9.]+/license)"),
    ("cecill", r"cecill\.info"),
    ("eupl", r"joinup\.ec\.europa\.eu/\S{0,80}?eupl"),
    ("spdx", r"spdx\.org/licenses/[\w.+-]+"),
)

#: Names of licences, with versions.
NAMES = (
    ("agpl", r"(?:gnu )?affero general public licen[sc]e(?:,? (?:v|version )?[0-9.]+)?(?: or (?:any )?later)?"),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public licen[sc]e(?:,? (?:v|version )?[0-9.]+)?(?: or (?:any )?later)?"),
    ("gpl", r"gnu general public licen[sc]e(?:,? (?:v|version )?[0-9.]+)?(?: or (?:any )?later)?"),
    ("gfdl", r"gnu free documentation licen[sc]e"),
    ("apache", r"apache (?:software )?licen[sc]e(?:,? (?:v|version )?[0-9.]+)?"),
    ("mit", r"(?:the )?(?:mit|expat) licen[sc]e"),
    ("x11", r"x11 licen[sc]e"),
    ("bsd-2-clause", r"(?:2-clause|two-clause|simplified|freebsd) bsd licen[sc]e"),
    ("bsd-3-clause", r"(?:3-clause|three-clause|new|revised|modified) bsd licen[sc]e"),
    ("bsd-4-clause", r"(?:4-clause|four-clause|original) bsd licen[sc]e"),
    ("bsd", r"bsd(?:-style)? licen[sc]e"),
    ("isc", r"isc licen[sc]e"),
    ("mpl", r"mozilla public licen[sc]e(?:,? (?:v|version )?[0-9.]+)?"),
    ("npl", r"netscape public licen[sc]e"),
    ("epl", r"eclipse public licen[sc]e(?: -? ?v? ?[0-9.]+)?"),
    ("edl", r"eclipse distribution licen[sc]e"),
    ("eupl", r"european union public licen[sc]e"),
    ("cddl", r"common development and distribution licen[sc]e"),
    ("cpl", r"common public licen[sc]e"),
    ("ipl", r"ibm public licen[sc]e"),
    ("apsl", r"apple public source licen[sc]e"),
    ("ms-pl", r"microsoft public licen[sc]e"),
    ("ms-rl", r"microsoft reciprocal licen[sc]e"),
    ("artistic", r"(?:perl )?artistic licen[sc]e(?: 2\.0)?"),
    ("zlib", r"zlib(?:/libpng)? licen[sc]e"),
    ("bsl-1.0", r"boost software licen[sc]e"),
    ("busl", r"business source licen[sc]e"),
    ("sspl", r"server side public licen[sc]e"),
    ("elastic", r"elastic licen[sc]e(?: 2\.0)?"),
    ("commons-clause", r"commons clause"),
    ("polyform", r"polyform (?:noncommercial|shield|perimeter|strict|small business) licen[sc]e"),
    ("openssl", r"openssl licen[sc]e"),
    ("ofl", r"(?:sil )?open font licen[sc]e"),
    ("odbl", r"open database licen[sc]e"),
    ("odc-by", r"open data commons attribution licen[sc]e"),
    ("pddl", r"public domain dedication and licen[sc]e"),
    ("ogl", r"open government licen[sc]e"),
    ("psf", r"python software foundation licen[sc]e"),
    ("php", r"php licen[sc]e"),
    ("ruby", r"ruby licen[sc]e"),
    ("postgresql", r"postgresql licen[sc]e"),
    ("unlicense", r"(?:the )?unlicense"),
    ("wtfpl", r"do what the \w+ you want to public licen[sc]e|wtfpl"),
    ("cecill", r"cecill(?:-[abc])?(?: free software)?(?: licen[sc]e)?"),
    ("afl", r"academic free licen[sc]e"),
    ("osl", r"open software licen[sc]e"),
    ("ecl", r"educational community licen[sc]e"),
    ("ncsa", r"(?:university of illinois/)?ncsa(?: open source)? licen[sc]e"),
    ("vim", r"vim licen[sc]e"),
    ("qpl", r"q public licen[sc]e"),
    ("zpl", r"zope public licen[sc]e"),
    ("upl", r"universal permissive licen[sc]e"),
    ("mulan", r"mulan (?:permissive|public) (?:software )?licen[sc]e"),
    ("blueoak", r"blue oak model licen[sc]e"),
    ("hippocratic", r"hippocratic licen[sc]e"),
    ("w3c", r"w3c software (?:notice and )?(?:and document )?licen[sc]e"),
    ("oracle-bcl", r"oracle binary code licen[sc]e"),
    ("intel", r"intel (?:simplified|open source) (?:software )?licen[sc]e"),
    ("llama", r"llama [0-9.]+ community licen[sc]e"),
    ("openrail", r"(?:bigscience )?(?:creativeml )?open ?rail(?:-m|\+\+-m)?(?: licen[sc]e)?"),
    ("cc0", r"creative commons zero(?: 1\.0)?(?: universal)?"),
    ("cc-by-nc-nd", r"cc[\s-]by[\s-]nc[\s-]nd"),
    ("cc-by-nc-nd", r"creative commons attribution[\s-]non-?commercial[\s-]no-?deriv\w*"),
    ("cc-by-nc-sa", r"cc[\s-]by[\s-]nc[\s-]sa"),
    ("cc-by-nc-sa", r"creative commons attribution[\s-]non-?commercial[\s-]share-?alike"),
    ("cc-by-nc", r"cc[\s-]by[\s-]nc"),
    ("cc-by-nc", r"creative commons attribution[\s-]non-?commercial"),
    ("cc-by-nd", r"cc[\s-]by[\s-]nd"),
    ("cc-by-nd", r"creative commons attribution[\s-]no-?deriv\w*"),
    ("cc-by-sa", r"cc[\s-]by[\s-]sa"),
    ("cc-by-sa", r"creative commons attribution[\s-]share-?alike"),
    ("cc-by", r"cc[\s-]by"),
    ("cc-by", r"creative commons attribution"),
    ("public-domain", r"in the public domain"),
)

#: Groups in order of priority, with the score of their detections.
GROUPS = ((TEXTS, 1.0), (NOTICES, 0.9), (IDS, 0.8), (LINKS, 0.7), (NAMES, 0.6))
