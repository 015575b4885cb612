"""License and rights statements, by ordered signature rules.

Every rule is a regular expression over a text's lower-cased words joined by
single spaces, with keywords: whole statements (grants, headers, exceptions,
notices, disclaimers) written out, and the names of licenses, each in five
uses. A text is searched only if it holds one of the
stems, one of which every rule needs, and a rule only if the text holds one of
its keywords; every branch of its expression needs one of them.
Detections are taken in order of priority, then length; one that lies inside an
interval already taken is suppressed, so ``lesser general public license`` does
not also report the plain one. Base phrases are always reported.

Defined cases: a null text is empty; equal priorities go by length, then place,
then label; work grows with a text's length times the logarithm of its
detections; repeated rows are separate; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import re
from functools import cache

from pyspark.sql import DataFrame

from . import words
from .arrow import map_texts

REPORT = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"

# The base phrases and their labels.
BASE = {b"cc by": "cc-by", b"general public license": "gpl", b"all rights reserved": "reserved"}

# Label, keywords of which every branch needs one, and how the name is
# written in words. A digit group such as "2 0" is "2.0" split at its dot.
NAMES = [
    ("apache-2.0", ("apache",), r"apache(?: software)?(?: licen[sc]e)?(?: version| v)? ?2(?: 0)?"),
    ("apache", ("apache",), r"apache(?: software)?"),
    ("mit", ("mit",), r"mit(?: x11| expat)?"),
    ("mit-0", ("mit",), r"mit (?:no attribution|0)"),
    ("bsd-2-clause", ("bsd",), r"(?:2 clause|two clause|simplified|freebsd) bsd|bsd 2(?: clause)?"),
    ("bsd-3-clause", ("bsd",), r"(?:3 clause|three clause|new|modified|revised) bsd|bsd 3(?: clause)?"),
    ("bsd-4-clause", ("bsd",), r"(?:4 clause|four clause|original|old) bsd|bsd 4(?: clause)?"),
    ("0bsd", ("bsd",), r"0bsd|(?:zero clause|0 clause) bsd"),
    ("bsd", ("bsd",), r"bsd(?: style)?"),
    ("gpl-2.0", ("gpl", "general public"), r"(?:gnu )?(?:gpl|general public licen[sc]e)(?: gpl)?(?: version| v)? ?2(?: 0)?"),
    ("gpl-3.0", ("gpl", "general public"), r"(?:gnu )?(?:gpl|general public licen[sc]e)(?: gpl)?(?: version| v)? ?3(?: 0)?"),
    ("gpl", ("gpl", "general public"), r"gnu (?:gpl|general public)|gpl"),
    ("lgpl-2.1", ("lgpl", "lesser general"), r"(?:gnu )?(?:lgpl|lesser general public licen[sc]e)(?: lgpl)?(?: version| v)? ?2(?: 1)?"),
    ("lgpl-3.0", ("lgpl", "lesser general"), r"(?:gnu )?(?:lgpl|lesser general public licen[sc]e)(?: lgpl)?(?: version| v)? ?3(?: 0)?"),
    ("lgpl", ("lgpl", "lesser general", "library general"), r"(?:gnu )?(?:lesser|library) general public(?: licen[sc]e)?|lgpl"),
    ("agpl-3.0", ("agpl", "affero"), r"(?:gnu )?(?:agpl|affero general public licen[sc]e)(?: agpl)?(?: version| v)? ?3(?: 0)?"),
    ("agpl", ("agpl", "affero"), r"(?:gnu )?affero general public(?: licen[sc]e)?|agpl"),
    ("gfdl", ("free documentation", "gfdl"), r"(?:gnu )?free documentation|gfdl"),
    ("mpl-1.1", ("mozilla", "mpl"), r"(?:mozilla public licen[sc]e|mpl)(?: version| v)? ?1 1"),
    ("mpl-2.0", ("mozilla", "mpl"), r"(?:mozilla public licen[sc]e|mpl)(?: version| v)? ?2(?: 0)?"),
    ("mpl", ("mozilla", "mpl"), r"mozilla public|mpl"),
    ("epl-1.0", ("eclipse", "epl"), r"(?:eclipse public licen[sc]e|epl)(?: version| v)? ?1(?: 0)?"),
    ("epl-2.0", ("eclipse", "epl"), r"(?:eclipse public licen[sc]e|epl)(?: version| v)? ?2(?: 0)?"),
    ("epl", ("eclipse", "epl"), r"eclipse public|epl"),
    ("eupl", ("european", "eupl"), r"european union public|eupl"),
    ("cddl", ("common development", "cddl"), r"common development and distribution|cddl"),
    ("cpl", ("common public",), r"common public"),
    ("cecill", ("cecill",), r"cecill(?: [abc])?"),
    ("artistic-2.0", ("artistic",), r"artistic(?: licen[sc]e)?(?: version| v)? ?2(?: 0)?"),
    ("artistic", ("artistic",), r"artistic"),
    ("boost", ("boost",), r"boost(?: software)?(?: 1 0)?"),
    ("isc", ("isc",), r"isc"),
    ("zlib", ("zlib",), r"zlib(?: libpng)?"),
    ("unlicense", ("unlicen",), r"unlicen[sc]e"),
    ("wtfpl", ("wtfpl", "do what the f"), r"wtfpl|do what the f\w{1,12} you want to(?: public)?"),
    ("ofl", ("font",), r"(?:sil )?open font"),
    ("osl-3.0", ("open",), r"open software licen[sc]e(?: version| v)? ?3(?: 0)?"),
    ("afl-3.0", ("academic",), r"academic free"),
    ("psf", ("python", "psf"), r"python software foundation|psf"),
    ("postgresql", ("postgresql",), r"postgresql"),
    ("php", ("php",), r"php(?: 3 01)?"),
    ("ruby", ("ruby",), r"ruby"),
    ("openssl", ("openssl",), r"openssl"),
    ("w3c", ("w3c",), r"w3c(?: software)?"),
    ("x11", ("x11",), r"x11"),
    ("ncsa", ("ncsa",), r"(?:university of illinois )?ncsa"),
    ("ms-pl", ("microsoft",), r"microsoft public"),
    ("ms-rl", ("microsoft",), r"microsoft reciprocal"),
    ("odbl", ("open database",), r"open database|odc open database"),
    ("odc-by", ("open data commons", "odc by"), r"open data commons attribution|odc by"),
    ("pddl", ("public domain", "pddl"), r"public domain dedication and|pddl"),
    ("cc0", ("cc0", "cc zero"), r"cc0(?: 1 0)?|cc zero"),
    ("cc-by-nc-nd", ("cc by", "cc attribution", "creative commons"), r"(?:cc|creative commons)(?: by|(?: )attribution)(?: nc| noncommercial| non commercial)(?: nd| noderivatives| no derivatives| noderivs)(?: \d \d)?"),
    ("cc-by-nc-sa", ("cc by", "cc attribution", "creative commons"), r"(?:cc|creative commons)(?: by|(?: )attribution)(?: nc| noncommercial| non commercial)(?: sa| sharealike| share alike)(?: \d \d)?"),
    ("cc-by-nc", ("cc by", "cc attribution", "creative commons"), r"(?:cc|creative commons)(?: by|(?: )attribution)(?: nc| noncommercial| non commercial)(?: \d \d)?"),
    ("cc-by-nd", ("cc by", "cc attribution", "creative commons"), r"(?:cc|creative commons)(?: by|(?: )attribution)(?: nd| noderivatives| no derivatives| noderivs)(?: \d \d)?"),
    ("cc-by-sa", ("cc by", "cc attribution", "creative commons"), r"(?:cc|creative commons)(?: by|(?: )attribution)(?: sa| sharealike| share alike)(?: \d \d)?"),
    ("cc-by", ("cc by", "cc attribution", "creative commons"), r"(?:cc by|creative commons attribution|cc attribution)(?: \d \d)?"),
    ("creative-commons", ("creative",), r"creative commons"),
]

# How a name is used; priority and confidence of the use, words of which one stands in it.
USES = [
    (90, 1.0, ("spdx",), r"spdx licen[sc]e identifier (?:{name})\b"),
    (80, 0.95, ("under",), r"(?:licen[sc]ed|released|distributed|available|published|provided|offered|shared|covered) (?:to you )?under (?:the |a |an )?(?:terms (?:and conditions )?of (?:the )?)?(?:{name})\b(?: licen[sc]e)?"),
    (70, 0.9, ("under", "subject to", "governed by", "accordance", "compliance", "terms of"), r"(?:subject to|governed by|in accordance with|compliance with|terms of|under) (?:the )?(?:{name})\b(?: licen[sc]e)?"),
    (60, 0.85, ("licen",), r"(?:{name})\b licen[sc]ed?\b"),
    (50, 0.8, ("licen",), r"licen[sc]e (?:is |the )?(?:{name})\b"),
]

# Rules that are whole statements; label, keywords of which every branch needs one, priority, confidence, expression.
STATEMENTS = [
    # grants
    ("mit", ("permission",), 85, 0.95, r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", ("above copyright",), 84, 0.9, r"the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies"),
    ("mit-0", ("deal in the software",), 84, 0.8, r"deal in the software without restriction including without limitation"),
    ("x11", ("x consortium", "except as contained"), 86, 0.9, r"(?:name of the x consortium|except as contained in this notice the name of)"),
    ("isc", ("permission",), 85, 0.95, r"permission to use copy modify and or distribute this software for any purpose"),
    ("0bsd", ("with or without fee is hereby granted",), 84, 0.8, r"with or without fee is hereby granted(?! provided)"),
    ("hpnd", ("supporting documentation",), 84, 0.9, r"appear in supporting documentation"),
    ("ntp", ("and its documentation",), 84, 0.85, r"permission to use copy modify and distribute this software and its documentation"),
    ("bsd", ("redistribution",), 85, 0.95, r"redistribution and use in source and binary forms with or without modification"),
    ("bsd-2-clause", ("reproduce the above",), 83, 0.85, r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", ("endorse or promote",), 86, 0.9, r"(?:neither the name of|the names? of) [a-z0-9 ]{1,120}? (?:may be used|nor the names of its contributors may be used) to endorse or promote products"),
    ("bsd-4-clause", ("advertising materials",), 87, 0.95, r"all advertising materials mentioning features or use of this software must display"),
    ("bsd-3-clause-clear", ("patent rights are granted",), 87, 0.9, r"no express or implied licen[sc]es to any party s patent rights are granted"),
    ("zlib", ("provided",), 85, 0.95, r"this software is provided as is without any express or implied warranty"),
    ("zlib", ("misrepresented",), 84, 0.9, r"the origin of this software must not be misrepresented"),
    ("zlib", ("altered source",), 84, 0.9, r"altered source versions must be plainly marked as such"),
    ("boost", ("machine executable",), 85, 0.95, r"machine executable object code generated by a source language processor"),
    ("boost", ("derivative works of the software",), 83, 0.8, r"prepare derivative works of the software and to permit third parties"),
    ("ncsa", ("with the software",), 83, 0.7, r"deal with the software without restriction"),
    ("postgresql", ("written agreement",), 84, 0.8, r"without fee and without a written agreement is hereby granted"),
    ("curl", ("appear in all copies",), 83, 0.7, r"provided that the above copyright notice and this permission notice appear in all copies"),
    ("wtfpl", ("do what the f",), 85, 0.95, r"you just do what the f\w{1,12} you want to"),
    ("beerware", ("beer",), 85, 0.9, r"(?:buy me a beer|beer ?ware licen[sc]e)"),
    ("unlicense", ("unencumbered",), 85, 0.95, r"free and unencumbered software released into the public domain"),
    ("unlicense", ("anyone is free",), 84, 0.9, r"anyone is free to copy modify publish use compile sell or distribute"),
    ("cc0", ("waived all copyright",), 85, 0.95, r"has waived all copyright and related or neighbo(?:u)?ring rights"),
    ("cc0", ("dedicated the work",), 85, 0.9, r"has dedicated the work to the public domain"),
    ("cc0", ("no copyright", "no rights"), 60, 0.7, r"no copyright reserved|no rights reserved under copyright"),
    ("blessing", ("blessing",), 85, 0.9, r"in place of a legal notice here is a blessing"),
    ("json", ("shall be used for good",), 86, 0.95, r"the software shall be used for good not evil"),
    ("vim", ("charityware",), 80, 0.8, r"vim is charityware"),
    ("imagemagick", ("imagemagick",), 80, 0.8, r"imagemagick studio llc"),
    ("libpng", ("png reference library",), 85, 0.9, r"png reference library (?:is supplied|and source code)"),
    ("ijg", ("independent jpeg group",), 85, 0.9, r"(?:based in part on )?the work of the independent jpeg group"),
    ("freetype", ("freetype",), 80, 0.8, r"(?:the freetype project|freetype (?:project )?licen[sc]e)"),
    ("unicode", ("unicode",), 80, 0.8, r"unicode (?:inc )?licen[sc]e agreement|unicode terms of use"),
    ("bzip2", ("julian",), 80, 0.8, r"julian seward"),
    ("openssl", ("openssl project",), 86, 0.9, r"developed by the openssl project"),
    ("ssleay", ("eric young",), 86, 0.9, r"cryptographic software written by eric young"),
    ("python", ("python software foundation", "psf"), 85, 0.9, r"psf is making python available to licensee|python software foundation licen[sc]e"),
    ("php", ("php software",), 85, 0.9, r"this product includes php software"),
    ("ruby", ("you may make and give away",), 84, 0.85, r"you may make and give away verbatim copies of the source form"),
    ("artistic", ("standard version",), 84, 0.85, r"distribute(?: verbatim copies)? of the standard version"),
    ("artistic", ("same terms as perl",), 84, 0.9, r"(?:under the )?same terms as perl(?: itself)?"),
    ("tcl", ("explicitly disclaimed",), 70, 0.6, r"terms apply to all files associated with the software unless explicitly disclaimed"),
    ("ofl", ("reserved font name",), 85, 0.9, r"with reserved font names?"),
    ("ofl", ("font software",), 85, 0.9, r"this font software is licen[sc]ed under"),
    ("bitstream-vera", ("bitstream vera",), 85, 0.9, r"bitstream vera is a trademark"),
    ("w3c", ("w3c",), 84, 0.85, r"w3c (?:software notice|document licen[sc]e|r software)"),
    ("eclipse", ("accompanying materials",), 85, 0.9, r"this program and the accompanying materials are made available under the terms of the eclipse"),
    ("epl-2.0", ("secondary licen",), 84, 0.85, r"secondary licen[sc]es? when the conditions for such availability"),
    ("apache-2.0", ("compliance",), 85, 0.9, r"you may not use this (?:file|work|software) except in compliance with the licen[sc]e"),
    ("apache-2.0", ("agreed to in writing",), 84, 0.85, r"unless required by applicable law or agreed to in writing software"),
    ("apache-2.0", ("contributor licen",), 84, 0.8, r"licen[sc]ed to the apache software foundation asf under one or more contributor licen[sc]e agreements"),
    ("apache-1.1", ("apache software foundation",), 86, 0.8, r"this product includes software developed by the apache software foundation"),
    ("mpl-1.1", ("software distributed under the licen",), 84, 0.85, r"software distributed under the licen[sc]e is distributed on an as is basis without warranty of any kind either express or implied see the licen[sc]e for the specific language governing rights"),
    ("mpl-2.0", ("source code form",), 85, 0.95, r"this source code form is subject to the terms of the mozilla public"),
    ("mpl-2.0", ("mpl was not distributed",), 85, 0.95, r"if a copy of the mpl was not distributed with this file"),
    ("cddl", ("contents of this file",), 84, 0.9, r"the contents of this file are subject to the terms of (?:either )?the common development and distribution"),
    ("cpal", ("common public attribution",), 85, 0.9, r"common public attribution licen[sc]e"),
    ("osl-3.0", ("licensor has placed",), 85, 0.8, r"the licensor has placed the following licen[sc]ing notice"),
    ("ms-pl", ("reciprocal grants",), 70, 0.6, r"reciprocal grants for any file you distribute"),
    ("nist", ("national institute of standards",), 80, 0.7, r"developed at the national institute of standards and technology"),
    # copyleft
    ("gpl", ("redistribute",), 85, 0.9, r"you can redistribute it and or modify it under the terms of the gnu general public"),
    ("gpl", ("free software foundation",), 60, 0.7, r"published by the free software foundation"),
    ("gpl", ("received a copy of the gnu",), 84, 0.9, r"you should have received a copy of the gnu general public"),
    ("lgpl", ("received a copy of the gnu",), 84, 0.9, r"you should have received a copy of the gnu (?:lesser|library) general public"),
    ("agpl", ("received a copy of the gnu",), 84, 0.9, r"you should have received a copy of the gnu affero general public"),
    ("gpl-2.0-or-later", ("or at your option",), 88, 0.9, r"either version 2 of the licen[sc]e or at your option any later version"),
    ("gpl-3.0-or-later", ("or at your option",), 88, 0.9, r"either version 3 of the licen[sc]e or at your option any later version"),
    ("lgpl-2.1-or-later", ("or at your option",), 88, 0.9, r"either version 2 1 of the licen[sc]e or at your option any later version"),
    ("gpl-2.0-only", ("version 2",), 86, 0.85, r"under the terms of the gnu general public licen[sc]e version 2 (?:only|as published)"),
    ("gpl-classpath-exception", ("special exception",), 88, 0.9, r"as a special exception the copyright holders(?: of this library)? give you permission to link"),
    ("gpl-linking-exception", ("linking this library",), 87, 0.85, r"linking this library statically or dynamically with other modules"),
    ("gcc-exception", ("runtime library exception",), 88, 0.9, r"gcc runtime library exception"),
    ("autoconf-exception", ("autoconf",), 86, 0.8, r"configure scripts? generated by autoconf|output of autoconf"),
    ("bison-exception", ("bison parser",), 86, 0.8, r"larger work that contains part or all of the bison parser skeleton"),
    ("gfdl", ("invariant sections",), 85, 0.9, r"with (?:no|the) invariant sections"),
    ("agpl", ("remote network interaction",), 85, 0.9, r"remote network interaction use with the gnu general public"),
    ("sspl", ("server side public", "sspl"), 85, 0.95, r"server side public licen[sc]e|\bsspl\b"),
    ("busl", ("business source",), 85, 0.95, r"business source licen[sc]e"),
    ("elastic", ("elastic licen",), 85, 0.9, r"elastic licen[sc]e(?: 2 0)?"),
    ("commons-clause", ("commons clause",), 85, 0.95, r"commons clause licen[sc]e condition|\bcommons clause\b"),
    ("polyform", ("polyform",), 85, 0.9, r"polyform (?:noncommercial|small business|shield|strict|perimeter)"),
    ("parity", ("parity public",), 85, 0.9, r"parity public licen[sc]e"),
    ("confluent", ("confluent community",), 85, 0.9, r"confluent community licen[sc]e"),
    ("ethical", ("hippocratic",), 85, 0.9, r"hippocratic licen[sc]e"),
    ("rail", ("responsible ai", "open rail", "openrail"), 85, 0.9, r"(?:creativeml )?open ?rail(?: m)?|responsible ai licen[sc]e"),
    ("llama-community", ("community licen",), 85, 0.85, r"llama [0-9 ]{0,6}community licen[sc]e"),
    # creative works and data
    ("creative-commons", ("creativecommons org",), 80, 0.85, r"creativecommons org licen[sc]es"),
    ("cc-by", ("creativecommons org",), 82, 0.95, r"creativecommons org licen[sc]es by \d \d"),
    ("cc-by-sa", ("creativecommons org",), 82, 0.95, r"creativecommons org licen[sc]es by sa \d \d"),
    ("cc-by-nc", ("creativecommons org",), 82, 0.95, r"creativecommons org licen[sc]es by nc \d \d"),
    ("cc-by-nd", ("creativecommons org",), 82, 0.95, r"creativecommons org licen[sc]es by nd \d \d"),
    ("cc-by-nc-sa", ("creativecommons org",), 82, 0.95, r"creativecommons org licen[sc]es by nc sa \d \d"),
    ("cc-by-nc-nd", ("creativecommons org",), 82, 0.95, r"creativecommons org licen[sc]es by nc nd \d \d"),
    ("cc0", ("creativecommons org",), 82, 0.95, r"creativecommons org publicdomain zero"),
    ("public-domain", ("creativecommons org",), 82, 0.9, r"creativecommons org publicdomain mark"),
    ("creative-commons", ("some rights reserved",), 50, 0.6, r"some rights reserved"),
    ("gutenberg", ("project gutenberg", "book is for the use"), 80, 0.9, r"project gutenberg (?:tm )?licen[sc]e|this e ?book is for the use of anyone anywhere"),
    ("odbl", ("opendatacommons",), 82, 0.95, r"opendatacommons org licen[sc]es odbl"),
    ("odc-by", ("opendatacommons",), 82, 0.95, r"opendatacommons org licen[sc]es by"),
    ("pddl", ("opendatacommons",), 82, 0.95, r"opendatacommons org licen[sc]es pddl"),
    ("ogl-uk", ("open government",), 82, 0.9, r"open government licen[sc]e"),
    ("etalab", ("etalab",), 82, 0.9, r"(?:licence ouverte|open licen[sc]e) etalab|etalab (?:licence|open licen[sc]e)"),
    ("dl-de-by", ("datenlizenz",), 82, 0.9, r"datenlizenz deutschland"),
    ("openstreetmap", ("openstreetmap",), 70, 0.8, r"openstreetmap contributors"),
    ("crown-copyright", ("crown copyright",), 70, 0.85, r"crown copyright(?: reserved)?"),
    ("us-government-work", ("united states government",), 70, 0.8, r"work of the united states government|united states government work"),
    ("public-domain", ("public domain",), 40, 0.7, r"(?:dedicated to|released into|placed in|is in|entered) the public domain"),
    ("free-art", ("free art", "art libre"), 82, 0.9, r"free art licen[sc]e|licence art libre"),
    # terms of use
    ("noncommercial", ("commercial",), 45, 0.6, r"(?:for )?non ?commercial (?:use|purposes) only"),
    ("noncommercial", ("personal",), 45, 0.6, r"for (?:your )?personal (?:and non ?commercial )?use only"),
    ("research-only", ("research", "academic", "educational"), 45, 0.6, r"for (?:academic|research|educational)(?: and (?:academic|research|educational))? (?:use|purposes) only"),
    ("evaluation-only", ("evaluation",), 45, 0.6, r"for evaluation (?:use|purposes) only"),
    ("no-derivatives", ("derivative",), 45, 0.5, r"may not (?:create|make|prepare) derivative works"),
    ("no-redistribution", ("redistribut",), 45, 0.6, r"(?:may not be|not for) (?:copied or )?redistribut(?:ed|ion)"),
    ("no-redistribution", ("reproduction",), 45, 0.6, r"(?:unauthorized|unauthorised) (?:use |copying |duplication |distribution |and |or )*reproduction"),
    ("proprietary", ("propriet",), 40, 0.7, r"proprietary(?: and confidential)?(?: licen[sc]e| software| information)"),
    ("proprietary", ("reproduc",), 40, 0.6, r"no part of this (?:publication|work|document|book) may be reproduced"),
    ("proprietary", ("trade secret",), 42, 0.7, r"(?:contains|constitutes?) (?:valuable )?trade secrets?"),
    ("proprietary", ("prior written",), 42, 0.6, r"without (?:the )?(?:express )?prior written (?:permission|consent|approval)"),
    ("proprietary", ("strictly prohibited",), 42, 0.6, r"(?:copying|distribution|reproduction|use) [a-z ]{0,60}is strictly prohibited"),
    ("proprietary", ("licensed not sold",), 45, 0.8, r"(?:is )?licensed not sold"),
    ("eula", ("end user licen",), 60, 0.85, r"end user licen[sc]e agreement"),
    ("eula", ("installing",), 50, 0.7, r"by installing (?:or using )?(?:this|the) software you (?:accept|agree)"),
    ("terms-of-service", ("terms of service",), 40, 0.6, r"(?:subject to|agree to) (?:the|our|these) terms of service"),
    ("fair-use", ("fair use",), 40, 0.5, r"(?:constitutes|considered|qualifies as) (?:a )?fair use"),
    ("dmca", ("digital millennium",), 40, 0.6, r"digital millennium copyright act"),
    ("export-control", ("export",), 30, 0.5, r"export administration regulations|export control laws"),
    ("us-government-rights", ("restricted rights",), 50, 0.7, r"government restricted rights|restricted rights legend"),
    ("trademark", ("trademark",), 20, 0.4, r"(?:registered )?trademarks? (?:of|are the property of) (?:their|its) respective (?:owners?|holders?)"),
    # warranty and liability
    ("no-warranty", ("warrant",), 20, 0.5, r"without (?:any )?warranty(?: of any kind)?"),
    ("no-warranty", ("merchantability",), 22, 0.6, r"implied warrant(?:y|ies) of merchantability"),
    ("no-warranty", ("fitness for a particular",), 21, 0.6, r"fitness for a particular purpose"),
    ("no-warranty", ("provided as is",), 20, 0.5, r"provided as is"),
    ("no-liability", ("liable",), 22, 0.6, r"in no event shall [a-z0-9 ]{1,120}? be liable"),
    ("no-liability", ("consequential",), 21, 0.6, r"(?:incidental|special|exemplary) [a-z ]{0,40}consequential damages"),
    # copyright marks
    ("copyright", ("copyright",), 10, 0.4, r"copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)?"),
    ("copyright", ("copyright",), 10, 0.4, r"copyright (?:holders?|owners?|notice)"),
    ("copyright", ("copyrighted",), 10, 0.4, r"copyrighted (?:material|work|by)"),
    ("spdx-copyright", ("spdx filecopyrighttext",), 30, 0.6, r"spdx filecopyrighttext"),
    ("reserved", ("rights reserved",), 12, 0.5, r"(?:19|20)\d\d [a-z0-9 ]{1,60}?rights reserved"),
    ("reserved", ("rechte vorbehalten",), 12, 0.5, r"alle rechte vorbehalten"),
    ("reserved", ("droits",), 12, 0.5, r"tous droits r[^ ]{1,4}serv[^ ]{1,4}s"),
    ("reserved", ("derechos reservados",), 12, 0.5, r"todos los derechos reservados"),
]

#: every rule and base phrase needs one of these in the joined words
STEMS = tuple(dict.fromkeys([*(w.encode() for _, _, words_, _ in USES for w in words_), *(k.encode() for _, keys, _, _, _ in STATEMENTS for k in keys), *BASE]))


@cache
def rules() -> list[tuple[str, tuple[str, ...], tuple[str, ...], int, float, re.Pattern]]:
    """(label, keywords of the name, words of the use, priority, confidence, expression): every name in every use, and the statements."""
    out = [(label, keys, some, p * 100 + len(name.split("|")[0]) // 4, sure, use.format(name=name)) for label, keys, name in NAMES for p, sure, some, use in USES]
    out += [(label, keys, keys, p * 100, sure, x) for label, keys, p, sure, x in STATEMENTS]
    return [(label, keys, some, p, sure, re.compile(rf"\b(?:{x})", re.ASCII)) for label, keys, some, p, sure, x in out]


def base_places(joined: bytes) -> list[tuple[int, str]]:
    """(first word, label) of every place of a base phrase."""
    found = []
    padded = b" " + joined + b" "
    for phrase, label in BASE.items():
        at = padded.find(b" " + phrase + b" ")
        word, counted = 0, 0
        while at >= 0:
            word, counted = word + padded.count(b" ", counted, at), at
            found.append((word, label))
            at = padded.find(b" " + phrase + b" ", at + 1)
    return found


class Taken:
    """Intervals by start; whether one of them contains another interval, in logarithmic time (a Fenwick tree of largest ends)."""

    def __init__(self, starts: list[int]):
        self.starts = sorted(set(starts))
        self.ends = [-1] * (len(self.starts) + 1)

    def add(self, start: int, end: int) -> None:
        i = bisect.bisect_left(self.starts, start) + 1
        while i < len(self.ends):
            self.ends[i] = max(self.ends[i], end)
            i += i & -i

    def contains(self, start: int, end: int) -> bool:
        i = bisect.bisect_right(self.starts, start)
        while i:
            if self.ends[i] >= end:
                return True
            i -= i & -i
        return False


def detections(joined: bytes) -> list[tuple[int, int, str, float]]:
    """Detections that no stronger one contains: (start, end, label, confidence), in characters."""
    text = joined.decode("utf-8", "replace")
    found, held = [], {}
    for label, keys, some, priority, sure, x in rules():
        for group in (some, keys):
            if group not in held:
                held[group] = any(w in text for w in group)
        if held[some] and held[keys]:
            found += [(-priority, m.start() - m.end(), m.start(), m.end(), label, sure) for m in x.finditer(text)]
    covered, taken = Taken([x[2] for x in found]), []
    for _, _, start, end, label, sure in sorted(found):
        if not covered.contains(start, end):
            covered.add(start, end)
            taken.append((start, end, label, sure))
    return taken


def scan(text: bytes | None) -> tuple:
    doc = words.alnum(text)
    if not doc:
        return 0, 0, None, None, "", "", 0.0
    joined = b" ".join(doc)
    if not any(stem in joined for stem in STEMS):
        return len(doc), 0, None, None, "", "", 0.0
    base = base_places(joined)
    more = detections(joined)
    starts = [x for x, _ in base]
    labels = {x for _, x in base}
    score = max([0.0, 0.5 * bool(base), *(x[3] for x in more)])
    return (
        len(doc), len(base), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(labels)), ",".join(sorted(labels | {x[2] for x in more})), score,
    )


def licenses(docs: DataFrame, *, keep: list[str] | None = None) -> DataFrame:
    def make():
        return lambda texts: [list(c) for c in zip(*map(scan, texts))]

    return map_texts(docs, make, REPORT, keep=keep)


def op8_license_rules(spark, sf_dir: str) -> DataFrame:
    return licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
