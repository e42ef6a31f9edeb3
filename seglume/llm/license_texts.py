"""Hand-written signatures: sentences that tell a license by its own text, over lower-case words joined by spaces.

Each line is (label, words or their beginnings that every match holds, regex, priority). These are looked for first; the regex runs only
where they stand. Longer and more specific sentences have higher priorities, as they name the license for sure.
"""

from __future__ import annotations

#: Sentences of public license texts.
SIGNATURES = (
    # MIT and its kin
    ("mit", "hereby granted free of charge", r"permission is hereby granted free of charge to any person obtaining a copy", 60),
    ("mit", "to deal in the software without restriction", r"to deal in the software without restriction including without limitation(?: the rights to use)?", 62),
    ("mit", "shall be included in all copies", r"(?:above|this) copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies", 61),
    ("mit-0", "mit no attribution", r"(?:the )?mit no attribution(?: licen[sc]e)?", 72),
    ("x11", "x consortium", r"except as contained in this notice the name of the x consortium shall not be used", 75),
    ("mit-advertising", "shall not be used in advertising", r"shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authori[sz]ation(?: and acknowledgement)?", 63),
    ("isc", "permission to use copy modify", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted", 64),
    ("isc", "permission to use copy modify", r"permission to use copy modify and or distribute this software for any purpose", 60),
    ("0bsd", "zero clause bsd", r"(?:the )?(?:bsd )?zero clause bsd(?: licen[sc]e)?", 74),
    ("0bsd", "free public licen", r"free public licen[sc]e 1 0 0", 74),
    ("hpnd", "permission to use copy modify", r"permission to use copy modify and distribute this software and its documentation for any purpose(?: and without fee)? is hereby granted", 66),
    ("ntp", "suitability of this software", r"makes no representations about the suitability of this software for any purpose", 40),
    ("ntp", "suitability of this software", r"no representations about the suitability of this software for any purpose it is provided as is", 50),
    ("mit-feh", "shall be included in all copies", r"shall be included in all copies of the software its documentation and marketing publicity materials", 70),
    ("json", "used for good not evil", r"the software shall be used for good not evil", 95),
    ("beerware", "buy me a beer", r"you can buy me a beer in return", 95),
    ("beerware", "beer ware", r"the beer ware licen[sc]e(?: revision 42)?", 94),
    ("curl", "daniel stenberg", r"copyright(?: c)?(?: \d+)* daniel stenberg", 55),
    ("icu", "unicode", r"(?:unicode licen[sc]e(?: v3)?|unicode inc licen[sc]e agreement data files and software)", 80),
    ("zlib", "altered source versions", r"altered source versions must be plainly marked as such", 78),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented", 78),
    ("libpng", "contributing authors", r"the contributing authors and group 42 inc disclaim all warranties", 88),
    ("libpng", "png reference library", r"png reference library licen[sc]e(?: version 2)?", 86),
    ("boost-1", "executable object code", r"unless such copies or derivative works are solely in the form of machine executable object code", 88),
    ("unlicense", "unencumbered software", r"this is free and unencumbered software released into the public domain", 90),
    ("unlicense", "recognize copyright laws", r"in jurisdictions that recognize copyright laws the author or authors of this software dedicate", 88),
    ("wtfpl", "do what the fuck you want", r"do what the fuck you want to(?: public licen[sc]e)?", 92),
    ("blessing", "may you do good and not evil", r"may you do good and not evil(?: may you find forgiveness for yourself and forgive others)?", 92),
    # BSD
    ("bsd-2", "this list of conditions", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", 62),
    ("bsd", "redistribution and use in source and binary forms", r"redistribution and use in source and binary forms with or without modification are permitted", 60),
    ("bsd-3", "endorse or promote", r"neither the name of (?:\w+ ){1,12}may be used to endorse or promote products", 72),
    ("bsd-3", "endorse or promote", r"neither the name of (?:\w+ ){1,8}nor the names of its contributors may be used to endorse or promote products", 74),
    ("bsd-3-clear", "no express or implied licen", r"no express or implied licen[sc]es to any party s patent rights are granted by this licen[sc]e", 85),
    ("bsd-4", "all advertising materials", r"all advertising materials mentioning features or use of this software must display", 80),
    ("bsd-4-uc", "university of california berkeley", r"this product includes software developed by the university of california berkeley(?: and its contributors)?", 85),
    ("bsd-2-patent", "patent licen", r"bsd 2 clause plus patent licen[sc]e", 86),
    ("bsd-2-views", "official policies", r"views and conclusions contained in the software and documentation are those of the authors and should not be interpreted as representing official policies", 82),
    ("bsd-source", "source code must retain", r"redistributions of source code must retain the above copyright notice", 45),
    # Apache
    ("apache-2", "except in compliance with the licen", r"you may not use this (?:file|work) except in compliance with the licen[sc]e", 66),
    ("apache-2", "distributed on an as is basis", r"software distributed under the licen[sc]e is distributed on an as is basis", 64),
    ("apache-2", "terms and conditions for use reproduction", r"terms and conditions for use reproduction and distribution", 70),
    ("apache-2", "grant of patent licen", r"grant of patent licen[sc]e subject to the terms and conditions of this licen[sc]e", 72),
    ("apache-1.1", "apache software foundation", r"this product includes software developed by the apache software foundation", 68),
    ("apache-1", "apache group", r"this product includes software developed by the apache group", 70),
    ("apache-notice", "under one or more contributor licen", r"licensed to the (?:apache software foundation|asf)(?: asf)? under one or more contributor licen[sc]e agreements", 74),
    # GNU
    ("gpl", "free software you can redistribute it", r"this (?:program|library|file) is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e", 66),
    ("gpl", "freedom to share and change", r"designed to take away your freedom to share and change(?: it| the works)?", 72),
    ("gpl-2", "version 2 june 1991", r"gnu general public licen[sc]e version 2 june 1991", 90),
    ("gpl-3", "29 june 2007", r"gnu general public licen[sc]e version 3 29 june 2007", 92),
    ("gpl-3", "tivoization", r"(?:anti )?tivoization", 30),
    ("gpl", "without even the implied warranty", r"without even the implied warranty of merchantability or fitness for a particular purpose", 48),
    ("gpl", "received a copy of the gnu general public licen", r"you should have received a copy of the gnu general public licen[sc]e", 64),
    ("lgpl", "received a copy of the gnu lesser general public licen", r"you should have received a copy of the gnu lesser general public licen[sc]e", 68),
    ("lgpl", "free software you can redistribute it", r"this (?:program|library|file) is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e", 70),
    ("lgpl-2.1", "february 1999", r"gnu lesser general public licen[sc]e version 2 1 february 1999", 92),
    ("lgpl", "work that uses the library", r"a work that uses the library", 46),
    ("agpl", "received a copy of the gnu affero general public licen", r"you should have received a copy of the gnu affero general public licen[sc]e", 68),
    ("agpl-3", "19 november 2007", r"gnu affero general public licen[sc]e version 3 19 november 2007", 92),
    ("agpl", "remotely through a computer network", r"users interacting with it remotely through a computer network", 66),
    ("gpl-classpath", "classpath exception", r"(?:gpl )?(?:with )?(?:the )?classpath exception", 80),
    ("gpl-classpath", "linking this library statically", r"linking this library statically or dynamically with other modules is making a combined work", 82),
    ("gpl-autoconf", "autoconf", r"autoconf (?:configure script )?exception", 78),
    ("gpl-gcc", "runtime library exception", r"gcc runtime library exception(?: version 3 1)?", 80),
    ("gpl-linux", "normal system calls", r"user programs that use kernel services by normal system calls", 84),
    ("gfdl", "invariant sections", r"with no invariant sections(?: with)? no front cover texts(?: and with)?(?: and)? no back cover texts", 86),
    ("gfdl", "permission is granted to copy distribute", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e", 84),
    ("fsf-unlimited", "free software foundation gives unlimited permission", r"the free software foundation gives unlimited permission to copy and or distribute it", 76),
    ("fsf-all-permissive", "copying and distribution of this file", r"copying and distribution of this file with or without modification are permitted in any medium without royalty", 78),
    ("copyleft-next", "copyleft next", r"copyleft next(?: 0 3)?(?: 0| 1)?", 70),
    # Mozilla, Eclipse and other file copyleft
    ("mpl-2", "subject to the terms of the mozilla public licen", r"this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0", 88),
    ("mpl-2", "incompatible with secondary licen", r"incompatible with secondary licen[sc]es as defined by the mozilla public licen[sc]e", 86),
    ("mpl-1.1", "contents of this file are subject to the mozilla public licen", r"the contents of this file are subject to the mozilla public licen[sc]e version 1 1", 88),
    ("npl", "netscape public licen", r"netscape public licen[sc]e(?: version 1 [01])?", 76),
    ("epl", "accompanying program is provided under the terms of this eclipse", r"the accompanying program is provided under the terms of this eclipse public licen[sc]e", 86),
    ("epl-2", "program and the accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e(?: v)? 2 0", 88),
    ("edl", "eclipse distribution licen", r"eclipse distribution licen[sc]e(?: v ?1 0)?", 78),
    ("cddl", "common development and distribution licen", r"subject to the terms of the common development and distribution licen[sc]e", 72),
    ("apsl", "apple public source licen", r"apple public source licen[sc]e(?: version)?(?: 2 0)?", 76),
    ("rpl", "reciprocal public licen", r"reciprocal public licen[sc]e(?: 1 5)?", 76),
    ("sissl", "sun industry standards", r"sun industry standards source licen[sc]e", 78),
    ("eupl", "licensed under the eupl", r"licensed under the eupl(?: version 1 [12]| v ?1 [12])?", 80),
    ("cpal", "common public attribution licen", r"common public attribution licen[sc]e(?: version)?(?: 1 0)?", 78),
    ("ibm-pibs", "ibm pibs", r"ibm pibs", 60),
    ("nasa", "nasa open source agreement", r"nasa open source agreement(?: version)?(?: 1 3)?", 80),
    ("ecl", "educational community licen", r"educational community licen[sc]e(?: version)?(?: [12] 0)?", 80),
    ("mulan-psl", "mulan psl", r"mulan psl v?2", 80),
    ("mulan-psl", "mulan permissive software licen", r"mulan permissive software licen[sc]e(?: v ?2)?", 80),
    ("ms-limited", "microsoft limited public licen", r"microsoft limited public licen[sc]e", 80),
    ("intel-acpi", "intel grants", r"intel grants free of charge to any person licensee", 70),
    ("sgi-b-2", "sgi free software licen", r"sgi free software licen[sc]e b(?: version)?(?: 2 0)?", 82),
    ("w3c", "w3c software notice", r"w3c software notice and (?:document )?licen[sc]e", 82),
    ("watcom", "sybase open watcom", r"sybase open watcom public licen[sc]e", 82),
    ("openldap", "openldap public licen", r"(?:the )?openldap public licen[sc]e(?: version 2 8)?", 82),
    ("naumen", "naumen public licen", r"naumen public licen[sc]e", 82),
    ("sleepycat", "sleepycat licen", r"(?:the )?sleepycat licen[sc]e", 82),
    ("ssh-openssl", "original ssleay licen", r"original ssleay licen[sc]e", 82),
    ("zpl", "zope public licen", r"zope public licen[sc]e(?: zpl)?(?: version)?(?: 2 [01])?", 80),
    ("tcl", "tcl tk licen", r"tcl tk licen[sc]e", 78),
    ("imagemagick", "imagemagick licen", r"(?:the )?imagemagick licen[sc]e", 78),
    ("ijg", "independent jpeg group", r"based in part on the work of the independent jpeg group", 84),
    ("freetype", "freetype project licen", r"(?:the )?freetype project licen[sc]e", 80),
    ("bitstream", "bitstream vera", r"bitstream vera fonts? copyright", 70),
    ("ofl", "reserved font name", r"with reserved font names?", 60),
    ("ofl-1.1", "sil open font licen", r"licensed under the sil open font licen[sc]e version 1 1", 90),
    # data, content, models
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?", 70),
    ("cc0", "creative commons zero", r"creative commons zero", 70),
    ("cc0", "waived all copyright", r"(?:has )?waived all copyright and related or neighboring rights", 84),
    ("cc-pddc", "public domain dedication", r"creative commons public domain dedication(?: and certification)?", 82),
    ("cc-by-nc", "non commercial purposes only", r"(?:for )?non commercial purposes only", 25),
    ("pddl", "public domain dedication and licen", r"open data commons public domain dedication and licen[sc]e", 86),
    ("odc-by", "open data commons attribution licen", r"open data commons attribution licen[sc]e", 86),
    ("cdla-permissive", "community data licen", r"community data licen[sc]e agreement permissive(?: version)?(?: [12] 0)?", 86),
    ("cdla-sharing", "community data licen", r"community data licen[sc]e agreement sharing(?: version)?(?: 1 0)?", 86),
    ("ogl-uk", "open government licen", r"open government licen[sc]e(?: v ?[123](?: 0)?)?", 80),
    ("etalab", "licence ouverte", r"licence ouverte(?: open licence)?(?: version)?(?: 2 0)?", 80),
    ("openrail", "openrail", r"(?:creativeml |bigscience )?(?:bigcode )?openrail(?: m)?(?: licen[sc]e)?", 76),
    ("openrail", "open rail", r"(?:creativeml |bigscience )?(?:bigcode )?open rail(?: m)?(?: licen[sc]e)?", 76),
    ("llama", "community licen", r"llama (?:2|3|3 1|4) community licen[sc]e(?: agreement)?", 84),
    ("gemma", "gemma terms of use", r"gemma terms of use", 84),
    ("public-domain", "the public domain", r"(?:released|dedicated|placed)(?: in| into| to)* the public domain", 50),
    ("public-domain", "work of the united states government", r"work of the united states government", 60),
    ("public-domain", "no known copyright restrictions", r"no known copyright restrictions", 55),
    ("free-art", "free art licen", r"(?:the )?free art licen[sc]e(?: 1 3)?", 78),
    ("dfsl", "digital peer publishing", r"digital peer publishing licen[sc]e", 78),
    # source available and reserved
    ("commons-clause", "commons clause", r"commons clause(?: licen[sc]e)?(?: condition v1 0)?", 84),
    ("busl", "change date", r"change date (?:\w+ ){0,12}change licen[sc]e", 74),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|shield|strict|perimeter|internal use|free trial)(?: licen[sc]e)?(?: 1 0 0)?", 86),
    ("prosperity", "prosperity public licen", r"(?:the )?prosperity public licen[sc]e(?: 3 0 0)?", 84),
    ("parity", "parity public licen", r"(?:the )?parity public licen[sc]e(?: 7 0 0| 6 0 0)?", 84),
    ("fsl", "functional source licen", r"functional source licen[sc]e(?: version)?(?: 1 1)?", 84),
    ("confluent", "confluent community licen", r"confluent community licen[sc]e(?: agreement)?", 84),
    ("redis-sal", "redis source available licen", r"redis source available licen[sc]e(?: agreement)?", 84),
    ("timescale", "timescale licen", r"timescale licen[sc]e(?: agreement)?", 80),
    ("oracle-bcl", "binary code licen", r"oracle binary code licen[sc]e agreement", 82),
    ("all-rights-reserved", "all rights reserved", r"all rights reserved", 20),
    ("proprietary", "proprietary and confidential", r"proprietary and confidential", 40),
    ("proprietary", "trade secret", r"(?:contains|constitutes) (?:\w+ ){0,4}trade secrets?", 30),
    ("proprietary", "copying of this file via any medium", r"unauthori[sz]ed copying of this file via any medium is strictly prohibited", 70),
    ("eula", "end user licen", r"end user licen[sc]e agreement", 45),
    ("no-warranty", "without warranty of any kind", r"as is without warranty of any kind", 10),
    ("no-warranty", "no warranty", r"there is no warranty for the program", 30),
)
