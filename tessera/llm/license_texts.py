"""Sentences of public licenses, each written as its words: label, keyword, tier, confidence, pattern.

A sentence that only one license has (tier 0) outweighs one that a family shares (tier 1)
and one that many notices have (tier 2). The keyword is a word of every text of the pattern.
"""

# Words of license texts and of the notices they prescribe.
TEXTS = (
    # permissive
    ("mit", "granted", 0, 0.99, r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "substantial", 1, 0.9, r"this permission notice shall be included in all copies or substantial portions"),
    ("mit", "sublicense", 1, 0.9, r"to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "persons", 1, 0.85, r"to permit persons to whom the software is furnished to do so"),
    ("mit-0", "furnished", 1, 0.8, r"persons to whom the software is furnished to do so the software is provided as is"),
    ("x11", "consortium", 0, 0.95, r"except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("isc", "granted", 0, 0.9, r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "author", 1, 0.85, r"the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("hpnd", "documentation", 0, 0.9, r"permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted"),
    ("hpnd", "publicity", 1, 0.85, r"not be used in advertising or publicity pertaining to distribution of the software without specific written prior permission"),
    ("bsd-2-clause", "redistribution", 1, 0.85, r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-2-clause", "redistributions", 1, 0.85, r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-2-clause", "reproduce", 1, 0.85, r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-2-clause", "freebsd", 0, 0.95, r"should not be interpreted as representing official policies either expressed or implied of the freebsd project"),
    ("bsd-3-clause", "endorse", 0, 0.9, r"neither the name of .{1,80} nor the names of its contributors may be used to endorse"),
    ("bsd-3-clause", "university", 1, 0.9, r"neither the name of the university nor the names of its contributors may be used"),
    ("bsd-3-clause-clear", "patent", 0, 0.9, r"no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-4-clause", "advertising", 0, 0.95, r"all advertising materials mentioning features or use of this software must display"),
    ("bsd-4-clause", "berkeley", 1, 0.9, r"this product includes software developed by the university of california berkeley and its contributors"),
    ("bsd-1-clause", "netbsd", 1, 0.8, r"this code is derived from software contributed to the netbsd foundation"),
    ("zlib", "misrepresented", 0, 0.95, r"the origin of this software must not be misrepresented"),
    ("zlib", "altered", 1, 0.9, r"altered source versions must be plainly marked as such and must not be misrepresented"),
    ("zlib", "notice", 1, 0.85, r"this notice may not be removed or altered from any source distribution"),
    ("libpng-2", "libpng", 0, 0.95, r"libpng is supplied as is the contributing authors and group 42 inc disclaim all warranties"),
    ("bsl-1", "boost", 0, 0.98, r"distributed under the boost software license version 1 0"),
    ("bsl-1", "accompanying", 0, 0.9, r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("ncsa", "contributors", 1, 0.85, r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers neither the names of .{1,80} contributors"),
    ("curl", "curl", 0, 0.95, r"see the curl license|curl is licensed under a mit x derivate license"),
    ("unicode", "unicode", 0, 0.95, r"a copy of the unicode data files and any associated documentation"),
    ("icu", "unicode", 1, 0.85, r"unicode inc license agreement data files and software"),
    ("openssl", "openssl", 0, 0.97, r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("openssl", "openssl", 1, 0.9, r"products derived from this software may not be called openssl"),
    ("ssleay", "cryptographic", 0, 0.95, r"this product includes cryptographic software written by eric young"),
    ("php-3", "php", 0, 0.97, r"this product includes php software freely available from"),
    ("php-3", "php", 1, 0.9, r"products derived from this software may not be called php"),
    ("zend-2", "zend", 0, 0.95, r"this product includes the zend engine freely available at"),
    ("postgresql", "california", 0, 0.9, r"in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages"),
    ("python-cwi", "mathematisch", 0, 0.95, r"the names of stichting mathematisch centrum or cwi not be used in advertising"),
    ("psf-2", "psf", 0, 0.95, r"psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("psf-2", "python", 1, 0.9, r"psf is making python available to licensee on an as is basis"),
    ("ruby", "verbatim", 1, 0.8, r"you may make and give away verbatim copies of the source form of the software without restriction"),
    ("tcl", "tcl", 1, 0.85, r"tcl tk license terms this software is copyrighted by the regents of the university of california"),
    ("vim", "vim", 0, 0.95, r"there are no restrictions on distributing unmodified copies of vim"),
    ("ijg", "jpeg", 0, 0.95, r"this software is based in part on the work of the independent jpeg group"),
    ("ftl", "freetype", 0, 0.95, r"portions of this software are copyright .{1,60}the freetype project"),
    ("info-zip", "zip", 0, 0.95, r"info zip is defined as the following set of individuals"),
    ("beerware", "beer", 0, 0.95, r"you can buy me a beer in return"),
    ("fair", "instrument", 0, 0.9, r"usage of the works is permitted provided that this instrument is retained with the works"),
    ("json", "evil", 0, 0.97, r"the software shall be used for good not evil"),
    ("upl-1", "larger", 0, 0.9, r"any piece of software and or hardware listed in the lrgrwrks txt file if one is included with the software each a larger work"),
    ("afl-3", "academic", 1, 0.85, r"licensed under the academic free license version [23] [01]"),
    ("ecl-2", "educational", 0, 0.95, r"licensed under the educational community license version 2 0"),
    ("ms-pl", "contributor", 1, 0.85, r"each contributor grants you a non exclusive worldwide royalty free copyright license to reproduce its contribution"),
    ("ms-rl", "reciprocal", 0, 0.9, r"reciprocal grants for any file you distribute that contains code from the software"),
    ("w3c", "w3c", 0, 0.95, r"w3c software (?:notice and|and document) license"),
    ("unlicense", "unencumbered", 0, 0.99, r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone", 1, 0.9, r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "want", 0, 0.9, r"do what the fuck you want to public license"),
    # apache
    ("apache-2", "apache", 0, 0.99, r"licensed under the apache license version 2 0 the license you may not use this file except in compliance"),
    ("apache-2", "apache", 1, 0.97, r"www apache org licenses license 2 0"),
    ("apache-2", "contributor", 1, 0.85, r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache-2", "license", 2, 0.8, r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-1.1", "apache", 0, 0.97, r"this product includes software developed by the apache software foundation"),
    ("apache-1.1", "apache", 1, 0.9, r"the names apache and apache software foundation must not be used to endorse"),
    ("apache-1", "apache", 0, 0.95, r"this product includes software developed by the apache group for use in the apache http server project"),
    # copyleft
    ("gpl-2", "gnu", 0, 0.98, r"gnu general public license as published by the free software foundation (?:either )?version 2"),
    ("gpl-2", "gnu", 0, 0.97, r"gnu general public license version 2 june 1991"),
    ("gpl-2", "program", 1, 0.8, r"you may copy and distribute verbatim copies of the program s source code as you receive it"),
    ("gpl-1", "gnu", 0, 0.97, r"gnu general public license version 1 february 1989"),
    ("gpl-3", "gnu", 0, 0.98, r"gnu general public license as published by the free software foundation (?:either )?version 3"),
    ("gpl-3", "gnu", 0, 0.97, r"gnu general public license version 3 29 june 2007"),
    ("gpl-3", "propagate", 1, 0.85, r"you may make run and propagate covered works that you do not convey without conditions"),
    ("gpl", "gnu", 2, 0.75, r"you should have received a copy of the gnu general public license along with this (?:program|software|file|library)"),
    ("gpl", "hope", 2, 0.7, r"distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "redistribute", 2, 0.7, r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl-2", "library", 0, 0.97, r"gnu library general public license as published by the free software foundation"),
    ("lgpl-2.1", "lesser", 0, 0.98, r"gnu lesser general public license as published by the free software foundation (?:either )?version 2 1"),
    ("lgpl-3", "lesser", 0, 0.98, r"gnu lesser general public license as published by the free software foundation (?:either )?version 3"),
    ("lgpl", "lesser", 2, 0.75, r"you should have received a copy of the gnu lesser general public license along with this (?:program|software|library)"),
    ("agpl-3", "affero", 0, 0.98, r"gnu affero general public license as published by the free software foundation"),
    ("agpl-3", "network", 1, 0.9, r"your modified version must prominently offer all users interacting with it remotely through a computer network"),
    ("gpl-exception-classpath", "linking", 0, 0.95, r"linking this library statically or dynamically with other modules is making a combined work based on this library"),
    ("gpl-exception-gcc", "runtime", 0, 0.95, r"under section 7 of gpl version 3 you are granted additional permissions described in the gcc runtime library exception"),
    ("gpl-exception-font", "font", 0, 0.9, r"if you create a document which uses this font and embed this font or unaltered portions of this font into the document"),
    ("gfdl-1.3", "invariant", 0, 0.95, r"with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-1.1", "mozilla", 0, 0.97, r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2", "mozilla", 0, 0.98, r"subject to the terms of the mozilla public license v ?2 0"),
    ("mpl-2", "incompatible", 0, 0.9, r"this source code form is incompatible with secondary licenses as defined by"),
    ("npl-1.1", "netscape", 0, 0.95, r"the contents of this file are subject to the netscape public license"),
    ("epl-1", "eclipse", 0, 0.97, r"the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2", "eclipse", 0, 0.97, r"made available under the terms of the eclipse public license"),
    ("cddl-1", "development", 0, 0.97, r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("cpl-1", "accompanying", 0, 0.95, r"the accompanying program is provided under the terms of this common public license"),
    ("eupl-1.2", "eupl", 0, 0.95, r"licensed under the eupl version 1 [12]"),
    ("osl-3", "osl", 1, 0.9, r"licensed under the osl 3 0"),
    ("apsl-2", "apple", 0, 0.95, r"this file contains original code and or modifications of original code as defined in and that are subject to the apple public source license"),
    ("sissl", "sun", 0, 0.95, r"the contents of this file are subject to the sun industry standards source license"),
    ("cecill-2", "cecill", 0, 0.95, r"this software is governed by the cecill(?: [bc])? license under french law"),
    ("artistic-1", "artistic", 1, 0.85, r"this (?:library|program) is free software you can redistribute it and or modify it under the (?:same terms as perl itself or the )?artistic license"),
    ("perl", "perl", 1, 0.85, r"you can redistribute it and or modify it under the same terms as perl itself"),
    ("artistic-2", "package", 1, 0.8, r"you are permitted to use the standard version and create and use modified versions for any purpose without restriction provided that you do not distribute the modified version of the package|copying modification and distribution of the package under the artistic license 2 0"),
    ("lppl-1.3", "latex", 0, 0.95, r"this work may be distributed and or modified under the conditions of the latex project public license"),
    ("ofl-1.1", "font", 0, 0.95, r"this font software is licensed under the sil open font license"),
    ("ofl-1.1", "font", 1, 0.9, r"the font software may be sold as part of a larger software package but no copy of one or more of the font software typefaces may be sold by itself"),
    # data and culture
    ("cc0", "waived", 0, 0.9, r"has waived all copyright and related or neighboring rights"),
    ("cc0", "creativecommons", 1, 0.95, r"creativecommons org publicdomain zero 1 0"),
    ("cc-pdm", "creativecommons", 1, 0.9, r"creativecommons org publicdomain mark 1 0"),
    ("cc-by", "creativecommons", 1, 0.95, r"creativecommons org licenses by [1234] 0"),
    ("cc-by-sa", "creativecommons", 1, 0.95, r"creativecommons org licenses by sa [1234] 0"),
    ("cc-by-nc", "creativecommons", 1, 0.95, r"creativecommons org licenses by nc [1234] 0"),
    ("cc-by-nd", "creativecommons", 1, 0.95, r"creativecommons org licenses by nd [1234] 0"),
    ("cc-by-nc-sa", "creativecommons", 1, 0.95, r"creativecommons org licenses by nc sa [1234] 0"),
    ("cc-by-nc-nd", "creativecommons", 1, 0.95, r"creativecommons org licenses by nc nd [1234] 0"),
    ("cc-by", "appropriate", 1, 0.85, r"you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-by-sa", "remix", 1, 0.85, r"if you remix transform or build upon the material you must distribute your contributions under the same license"),
    ("cc-by-nc", "commercial", 1, 0.8, r"you may not use the material for commercial purposes"),
    ("cc-by-nd", "remix", 1, 0.85, r"if you remix transform or build upon the material you may not distribute the modified material"),
    ("cc-by-sa", "wikipedia", 1, 0.8, r"text of wikipedia is available under the creative commons attribution share ?alike license"),
    ("cc-by", "cc", 4, 0.6, r"cc by(?: [1234] 0)?"),
    ("cc-by-sa", "sa", 4, 0.7, r"cc by sa(?: [1234] 0)?"),
    ("cc-by-nc", "nc", 4, 0.7, r"cc by nc(?: [1234] 0)?"),
    ("cc-by-nd", "nd", 4, 0.7, r"cc by nd(?: [1234] 0)?"),
    ("cc-by-nc-sa", "nc", 3, 0.8, r"cc by nc sa(?: [1234] 0)?"),
    ("cc-by-nc-nd", "nc", 3, 0.8, r"cc by nc nd(?: [1234] 0)?"),
    ("odbl-1", "database", 0, 0.95, r"any rights in individual contents of the database are licensed under the database contents license"),
    ("odbl-1", "openstreetmap", 1, 0.85, r"openstreetmap is open data licensed under the open data commons open database license"),
    ("ogl-uk-3", "government", 0, 0.95, r"contains public sector information licensed under the open government licence v?[123] 0"),
    ("gutenberg", "gutenberg", 0, 0.95, r"this e ?book is for the use of anyone anywhere .{0,120}project gutenberg license|project gutenberg license included with this e ?book"),
    ("public-domain", "domain", 2, 0.8, r"this (?:file|work|software|code) (?:is|has been placed) in(?:to)? the public domain"),
    ("public-domain", "blessing", 0, 0.9, r"the author disclaims copyright to this source code in place of a legal notice here is a blessing"),
    ("public-domain", "government", 1, 0.8, r"as a work of the united states government this (?:project|software|work) is in the public domain"),
    ("public-domain", "public", 4, 0.6, r"(?:released into|dedicated to|in) the public domain"),
    # source available and proprietary
    ("busl-1.1", "licensor", 0, 0.9, r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("sspl-1", "service", 0, 0.9, r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic-2", "managed", 0, 0.9, r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "sell", 0, 0.95, r"the license does not grant to you the right to sell the software"),
    ("polyform-nc", "polyform", 0, 0.95, r"polyform noncommercial license 1 0 0"),
    ("rail", "openrail", 0, 0.9, r"(?:creativeml|bigscience|bigcode) openrail m(?: license)?|openrail license"),
    ("all-rights-reserved", "reserved", 4, 0.7, r"all rights reserved"),
    ("proprietary", "proprietary", 4, 0.6, r"proprietary and confidential"),
    ("proprietary", "unauthorized", 3, 0.7, r"unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "trade", 3, 0.7, r"contains (?:valuable )?(?:confidential information and )?trade secrets"),
    ("proprietary", "written", 3, 0.6, r"no part of this (?:publication|document|work|book) may be reproduced .{0,120}without the prior written permission"),
    ("proprietary", "internal", 3, 0.6, r"for internal use only not for redistribution"),
    ("non-commercial", "commercial", 3, 0.6, r"for (?:personal|academic|research) and non commercial use only|not for commercial use"),
)
