"""Sentences of license texts, headers and notices, written out by hand.

Each is a label, a keyword that the sentence cannot lack, and an expression over
words: lower case, with everything that is not a letter or a digit as a space.
The order is that of the rules.
"""

SIGNATURES = (
    # MIT and its relatives
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "sublicense", "without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies"),
    ("mit", "permission", "the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions"),
    ("mit", "noninfringement", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit", "holders", "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("mit", "dealings", "the software or the use or other dealings in the software"),
    ("mit", "mit", "(?:this (?:project|software|code|package|library|file) is )?(?:free software )?(?:released|licensed|distributed) under (?:the )?(?:terms of )?(?:the )?mit"),
    ("mit", "mit", "see (?:the )?(?:file )?licen[cs]e(?: file| md| txt)? for (?:the )?mit"),
    ("mit-advertising", "advertising", "except as contained in this notice the names? of the above copyright holders? shall not be used in advertising"),
    ("x11", "consortium", "except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("x11", "supporting", "provided that the above copyright notices? (?:appears?|appear) in all copies and that both that copyright notices? and this permission notice appear in supporting documentation"),
    ("hpnd", "representations", "makes no representations about the suitability of this software for any purpose"),
    ("hpnd", "permission", "permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee"),
    ("hpnd", "publicity", "not be used in advertising or publicity pertaining to distribution of the software without specific(?: written)? prior(?: written)? permission"),
    ("hpnd", "disclaims", "disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("mit-0", "obtaining", "obtaining a copy of this software and associated documentation files the software to deal in the software without restriction (?:including without limitation the rights )?without attribution"),
    ("mit-modern", "paraphrase", "this license is a paraphrase of the mit"),
    ("jquery", "jquery", "(?:dual )?licensed under the mit (?:or gpl version 2 )?licenses? http jquery org license"),
    # ISC
    ("isc", "permission", "permission to use copy modify and (?:or )?distribute this software for any purpose"),
    ("isc", "disclaims", "the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("isc", "tortious", "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("isc", "consortium", "internet (?:systems|software) consortium (?:inc )?isc (?:disclaims|license)"),
    # BSD
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation"),
    ("bsd", "contributors", "this software is provided by the (?:copyright holders|regents|authors?) and contributors as is and any express or implied warranties"),
    ("bsd", "exemplary", "be liable for any direct indirect incidental special exemplary or consequential damages"),
    ("bsd", "procurement", "including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption"),
    ("bsd", "bsd", "use of this source code is governed by a bsd style licen[cs]e that can be found in the licen[cs]e file"),
    ("bsd", "bsd", "this (?:file|code|software|program) is (?:distributed|licensed|released) under (?:the|a) (?:terms of the )?bsd"),
    ("bsd-3-clause", "endorse", "may be used to endorse or promote products derived from this software"),
    ("bsd-3-clause", "neither", "neither the names? of (?:the )?(?:copyright holder|university|author|company|organization|regents)s? nor the names of (?:its|their|any) contributors"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-4-clause", "includes", "this product includes software developed by the university of california berkeley and its contributors"),
    ("bsd-2-clause", "conclusions", "the views and conclusions contained in the software and documentation are those of the authors and should not be interpreted as representing official policies"),
    ("bsd-3-clause-clear", "patent", "no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-3-clause-lbnl", "enhancements", "you are under no obligation whatsoever to provide any bug fixes patches or upgrades to the features functionality or performance of the source code enhancements"),
    ("bsd-0", "fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd-1-clause", "redistributions", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer this software is provided"),
    ("bsd-protection", "protection", "bsd protection license"),
    ("bsd-source-code", "redistributions", "redistributions of source code must retain the above copyright notice this condition and the following disclaimer"),
    # Apache
    ("apache-2.0", "apache", "licensed under the apache license version 2 0 the license"),
    ("apache-2.0", "compliance", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", "apache", "http www apache org licenses license 2 0"),
    ("apache-2.0", "basis", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "governing", "see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2.0", "contributor", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2.0", "apache", "apache license version 2 0 january 2004"),
    ("apache-2.0", "derivative", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of"),
    ("apache-2.0", "royalty", "grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable except as stated in this section patent license"),
    ("apache-2.0", "appendix", "appendix how to apply the apache license to your work"),
    ("apache-2.0", "notice", "if the work includes a notice text file as part of its distribution"),
    ("apache-1.1", "apache", "this product includes software developed by the apache software foundation"),
    ("apache-1.1", "apache", "the names apache and apache software foundation must not be used to endorse or promote products"),
    ("apache-1.1", "apache", "products derived from this software may not be called apache nor may apache appear in their name"),
    ("apache-1.0", "apache", "this product includes software developed by the apache group for use in the apache http server project"),
    # GNU
    ("gpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-2.0", "general", "gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0", "general", "gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2.0", "general", "gnu general public license version 2(?: only)? as published by the free software foundation"),
    ("gpl-3.0", "general", "gnu general public license version 3(?: only)? as published by the free software foundation"),
    ("gpl-2.0", "1991", "gnu general public license version 2 june 1991"),
    ("gpl-3.0", "2007", "gnu general public license version 3 29 june 2007"),
    ("gpl-1.0", "1989", "gnu general public license version 1 february 1989"),
    ("gpl", "general", "you should have received a copy of the gnu general public license along with this (?:program|software|library|file)"),
    ("gpl", "useful", "distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl", "general", "see the gnu general public license for more details"),
    ("gpl", "copyleft", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-2.0", "freedom", "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3.0", "installation", "installation information for a user product means any methods procedures authorization keys"),
    ("gpl", "absolutely", "comes with absolutely no warranty for details type show w"),
    ("gpl", "welcome", "this is free software and you are welcome to redistribute it under certain conditions"),
    ("gpl", "linking", "linking (?:this (?:library|program|module) )?statically or dynamically with other modules is making a combined work"),
    ("gpl-classpath", "exception", "as a special exception the copyright holders of this library give you permission to link this library with independent modules"),
    ("gpl-bison", "bison", "as a special exception you may create a larger work that contains part or all of the bison parser skeleton"),
    ("gpl-autoconf", "configure", "as a special exception (?:the free software foundation gives )?unlimited permission to copy distribute and modify the configure scripts"),
    ("gpl-gcc", "runtime", "under section 7 of gpl version 3 you are granted additional permissions described in the gcc runtime library exception"),
    ("gpl-font", "font", "as a special exception if you create a document which uses this font and embeds? this font"),
    ("gpl-openssl", "openssl", "permission to link (?:the code of )?(?:this|portions of this) (?:program|software|code) with the openssl"),
    ("lgpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("lgpl", "lesser", "gnu lesser general public license as published by the free software foundation"),
    ("lgpl-2.1", "lesser", "lesser general public license as published by the free software foundation either version 2 1 of the license"),
    ("lgpl-3.0", "lesser", "lesser general public license as published by the free software foundation either version 3 of the license"),
    ("lgpl-2.1", "1999", "gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-3.0", "2007", "gnu lesser general public license version 3 29 june 2007"),
    ("lgpl-2.0", "library", "you can redistribute it and or modify it under the terms of the gnu library general public license"),
    ("lgpl-2.0", "1991", "gnu library general public license version 2 june 1991"),
    ("lgpl", "lesser", "you should have received a copy of the gnu lesser general public license along with this"),
    ("agpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("agpl-3.0", "affero", "affero general public license as published by the free software foundation either version 3 of the license"),
    ("agpl-3.0", "affero", "gnu affero general public license version 3 19 november 2007"),
    ("agpl", "affero", "you should have received a copy of the gnu affero general public license along with this"),
    ("agpl-1.0", "affero", "affero general public license version 1 march 2002"),
    ("agpl-3.0", "remotely", "your modified version must prominently offer all users interacting with it remotely through a computer network"),
    ("gfdl", "documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", "invariant", "with no invariant sections no front cover texts and no back cover texts"),
    ("gfdl-1.3", "2008", "gnu free documentation license version 1 3 3 november 2008"),
    ("gfdl-1.2", "2002", "gnu free documentation license version 1 2 november 2002"),
    ("gfdl-1.1", "2000", "gnu free documentation license version 1 1 march 2000"),
    ("gnu-all-permissive", "medium", "copying and distribution of this file with or without modification are permitted in any medium without royalty"),
    # Mozilla, Netscape, Sun
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public license"),
    ("mpl-2.0", "mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-2.0", "incompatible", "this source code form is incompatible with secondary licenses as defined by the mozilla public license"),
    ("mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.0", "mozilla", "the contents of this file are subject to the mozilla public license version 1 0"),
    ("mpl", "mpl", "under the terms of any one of the mpl the gpl or the lgpl"),
    ("npl-1.1", "netscape", "the contents of this file are subject to the netscape public license"),
    ("spl-1.0", "sun", "the contents of this file are subject to the sun public license version 1 0"),
    ("cddl-1.0", "cddl", "common development and distribution license cddl version 1 0"),
    ("cddl", "development", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl", "distributing", "when distributing (?:the software|covered code) include this (?:cddl header|license header) notice in each file"),
    ("sissl", "sun", "sun industry standards source license"),
    ("interbase-1.0", "interbase", "the contents of this file are subject to the interbase public license"),
    ("nokia-1.0", "nokia", "nokia open source license"),
    ("rpsl-1.0", "realnetworks", "realnetworks public source license"),
    ("apsl-2.0", "apple", "this file contains original code and or modifications of original code as defined in and that are subject to the apple public source license"),
    ("apsl-1.1", "apple", "apple public source license version 1 1"),
    # Eclipse, IBM
    ("epl-1.0", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2.0", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0"),
    ("epl", "eclipse", "the accompanying program is provided under the terms of this eclipse public license"),
    ("edl-1.0", "eclipse", "eclipse distribution license v 1 0"),
    ("cpl-1.0", "common", "the accompanying program is provided under the terms of this common public license"),
    ("cpl-1.0", "common", "are made available under the terms of the common public license"),
    ("ipl-1.0", "ibm", "ibm public license version 1 0"),
    ("epl-2.0", "secondary", "this source code may also be made available under the following secondary licenses when the conditions for such availability set forth in the eclipse public license"),
    # short permissive ones
    ("boost-1.0", "boost", "distributed under the boost software license version 1 0"),
    ("boost-1.0", "boost", "boost software license version 1 0 august 17th 2003"),
    ("boost-1.0", "machine", "unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented"),
    ("zlib", "altered", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "warranty", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("libpng", "png", "the png reference library is supplied as is"),
    ("libpng", "libpng", "this code is released under the libpng license"),
    ("libtiff", "leffler", "the names of sam leffler and silicon graphics may not be used in any advertising"),
    ("ijg", "jpeg", "this software is based in part on the work of the independent jpeg group"),
    ("curl", "stenberg", "copyright (?:c )?(?:[0-9]{4} )+daniel stenberg"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "dedicate", "the author or authors of this software dedicate any and all copyright interest in the software to the public domain"),
    ("unlicense", "heirs", "for the benefit of the public at large and to the detriment of our heirs and successors"),
    ("wtfpl", "fuck", "do what the fuck you want to(?: public license)?"),
    ("wtfpl", "wtfpl", "licensed under (?:the )?wtfpl"),
    ("beerware", "beer", "(?:as long as you retain this notice )?you can do whatever you want with this stuff if we meet some day and you think this stuff is worth it you can buy me a beer"),
    ("beerware", "beerware", "(?:the )?beerware license"),
    ("postcardware", "postcard", "send (?:me|us) a postcard"),
    ("json", "evil", "the software shall be used for good not evil"),
    ("fair", "usage", "usage of the works is permitted provided that this instrument is retained with the works"),
    ("fsfap", "medium", "are permitted in any medium without royalty provided the copyright notice and this notice are preserved"),
    ("vim", "vim", "there are no restrictions on distributing unmodified copies of vim"),
    ("ntp", "suitability", "the university of delaware makes no representations about the suitability"),
    ("tcl-tk", "hereby", "the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose"),
    ("smail", "smail", "smail general public license"),
    ("sleepycat", "db", "redistributions in any form must be accompanied by information on how to obtain complete source code for the db software"),
    ("sqlite-blessing", "blessing", "in place of a legal notice here is a blessing may you do good and not evil"),
    ("sqlite-blessing", "forgiveness", "may you find forgiveness for yourself and forgive others"),
    ("blessing", "share", "may you share freely never taking more than you give"),
    ("afl-3.0", "academic", "licensed under the academic free license version 3 0"),
    ("afl", "academic", "academic free license(?: version)?"),
    ("osl-3.0", "osl", "osl ?3 0"),
    ("osl", "open", "open software license(?: version| v)? ?[123] [01]"),
    ("artistic-1.0", "artistic", "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control"),
    ("artistic-2.0", "package", "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("perl", "perl", "you (?:can|may) redistribute (?:it|them) and or modify (?:it|them) under the same terms as perl itself"),
    ("perl", "perl", "(?:is )?free software (?:and )?(?:is )?(?:distributed|available|licensed) under the same terms as perl"),
    ("ncsa", "deal", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction"),
    ("ncsa", "illinois", "university of illinois ncsa open source license"),
    ("llvm", "llvm", "part of the llvm project under the apache license v2 0 with llvm exceptions"),
    ("llvm", "illinois", "this file is distributed under the university of illinois open source license"),
    ("upl-1.0", "universal", "universal permissive license(?: v| version)? 1 0"),
    ("upl-1.0", "larger", "any piece of software and or hardware listed in the larger ?works txt file"),
    ("bsl-1.1", "business", "business source license(?: 1 1)?"),
    ("sspl-1.0", "server", "server side public license"),
    ("elastic-2.0", "elastic", "elastic license(?: 2 0)?"),
    ("commons-clause", "clause", "commons clause license condition"),
    ("polyform", "polyform", "polyform (?:noncommercial|small business|shield|strict|perimeter|free trial|internal use) license"),
    ("blueoak-1.0", "blue", "blue oak model license"),
    ("mulan", "mulan", "mulan (?:psl|permissive software license)"),
    ("cecill", "cecill", "governed by the cecill(?: [bc])? license under french law"),
    ("cecill", "cecill", "cecill (?:free software )?license(?: agreement)?"),
    ("eupl-1.2", "eupl", "licensed under the eupl(?: version)?(?: v)? ?1 2"),
    ("eupl-1.1", "eupl", "licensed under the eupl(?: version)?(?: v)? ?1 1"),
    ("eupl", "european", "european union public licen[cs]e"),
    ("liliq", "quebec", "licence libre du quebec"),
    ("qpl-1.0", "q", "q public license"),
    ("qt-commercial", "qt", "commercial license usage licensees holding valid commercial qt licenses"),
    ("gpl-qt", "alternatively", "gnu general public license usage alternatively this file may be used under the terms of the gnu general public license"),
    ("reciprocal-1.5", "reciprocal", "reciprocal public license(?: version)? ?1 5"),
    ("simple-2.0", "simple", "simple public license 2 0"),
    ("watcom-1.0", "sybase", "sybase open watcom public license"),
    ("w3c", "w3c", "w3c software (?:notice and license|and document notice)"),
    ("w3c", "obtaining", "by obtaining using and or copying this work you the licensee agree that you have read understood and will comply"),
    ("zpl-2.1", "zope", "zope public license(?: zpl)?(?: version)? ?2 1"),
    ("zpl", "zope", "subject to the provisions of the zope public license"),
    ("zend-2.0", "zend", "(?:the zend engine license version 2 00|this product includes the zend engine)"),
    ("php-3.01", "php", "this source file is subject to version 3 01 of the php license"),
    ("php-3.0", "php", "this source file is subject to version 3 0 of the php license"),
    ("php", "php", "this product includes php software freely available from"),
    ("psf-2.0", "python", "python software foundation license version 2"),
    ("psf-2.0", "psf", "psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("python-cwi", "stichting", "stichting mathematisch centrum"),
    ("python-cnri", "cnri", "cnri (?:open source |python )?license(?: agreement)?"),
    ("ruby", "ruby", "(?:the )?same (?:terms|license) as ruby"),
    ("openssl", "openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("openssl", "openssl", "products derived from this software may not be called openssl nor may openssl appear in their names"),
    ("ssleay", "cryptographic", "this product includes cryptographic software written by eric young"),
    ("postgresql", "california", "in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages"),
    ("postgresql", "postgresql", "portions copyright (?:c )?[0-9 ]+ (?:the )?postgresql global development group"),
    ("unicode", "unicode", "unicode data files and software"),
    ("unicode", "unicode", "copyright (?:c )?[0-9 ]+ unicode inc all rights reserved(?: distributed under the terms of use)?"),
    ("icu", "icu", "icu license icu 1 8 1 and later"),
    ("freetype", "freetype", "portions of this software are copyright (?:c )?[0-9 ]*the freetype project"),
    ("freetype", "freetype", "(?:the )?freetype (?:project )?license"),
    ("bzip2", "bzip2", "this program bzip2 (?:the )?associated library libbzip2"),
    ("infozip", "zip", "this is version [0-9 a-z]+of the info zip license"),
    ("cups", "cups", "cups license agreement"),
    ("xfree86", "xfree86", "this product includes software developed by the xfree86 project"),
    ("nist", "institute", "this software was developed (?:at|by employees of) the national institute of standards and technology(?: nist)?"),
    ("nasa-1.3", "nasa", "nasa open source agreement"),
    ("us-government", "government", "(?:this (?:is a )?work of the|works? created by) (?:u s|us|united states) government(?: employees)?"),
    ("intel-acpi", "intel", "intel grants free of charge to any person licensee obtaining a copy of the source code"),
    ("nvidia", "nvidia", "nvidia corporation and its licensors retain all intellectual property"),
    ("ms-pl", "accompanying", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("ms-rl", "microsoft", "microsoft reciprocal license ms rl"),
    ("ms-lpl", "microsoft", "microsoft limited public license"),
    ("oracle-bcl", "oracle", "oracle binary code license agreement"),
    ("oracle-otn", "oracle", "oracle technology network license agreement"),
    ("sun-bcl", "sun", "sun microsystems inc binary code license agreement"),
    # content and data
    ("cc-by-4.0", "creative", "creative commons attribution 4 0 international(?: public)? license"),
    ("cc-by-3.0", "creative", "creative commons attribution 3 0 (?:unported|united states)"),
    ("cc-by-sa-4.0", "creative", "creative commons attribution sharealike 4 0 international"),
    ("cc-by-sa-3.0", "creative", "creative commons attribution share ?alike 3 0 (?:unported|united states)"),
    ("cc-by-nc-4.0", "creative", "creative commons attribution non ?commercial 4 0 international"),
    ("cc-by-nc-sa-4.0", "creative", "creative commons attribution non ?commercial share ?alike 4 0 international"),
    ("cc-by-nd-4.0", "creative", "creative commons attribution no ?derivatives 4 0 international"),
    ("cc-by", "creativecommons", "creativecommons org licenses by [1-4] 0"),
    ("cc-by-sa", "creativecommons", "creativecommons org licenses by sa [1-4] 0"),
    ("cc-by-nc", "creativecommons", "creativecommons org licenses by nc [1-4] 0"),
    ("cc-by-nd", "creativecommons", "creativecommons org licenses by nd [1-4] 0"),
    ("cc-by-nc-sa", "creativecommons", "creativecommons org licenses by nc sa [1-4] 0"),
    ("cc-by-nc-nd", "creativecommons", "creativecommons org licenses by nc nd [1-4] 0"),
    ("cc0", "creativecommons", "creativecommons org publicdomain zero 1 0"),
    ("cc-pdm", "creativecommons", "creativecommons org publicdomain mark 1 0"),
    ("cc0", "waived", "has waived all copyright and related or neighboring rights to this work"),
    ("cc0", "dedicated", "(?:the person who associated a work with this deed has )?dedicated the work to the public domain by waiving"),
    ("cc0", "cc0", "cc0 1 0 universal"),
    ("cc-sampling", "sampling", "creative commons sampling plus"),
    ("odbl-1.0", "database", "(?:made available under the )?open database license(?: odbl)?"),
    ("odc-by", "attribution", "open data commons attribution license"),
    ("pddl-1.0", "dedication", "public domain dedication and license(?: pddl)?"),
    ("cdla", "community", "community data license agreement (?:permissive|sharing)"),
    ("ogl-uk", "sector", "contains public sector information licensed under the open government licen[cs]e"),
    ("ogl-uk", "government", "open government licen[cs]e v(?:ersion )?[123] 0"),
    ("ofl-1.1", "font", "this font software is licensed under the sil open font license"),
    ("ofl-1.1", "font", "sil open font license version 1 1 26 february 2007"),
    ("ofl-1.1", "bundled", "original or modified versions of the font software may be bundled redistributed and or sold with any software"),
    ("bitstream-vera", "bitstream", "bitstream vera is a trademark of bitstream"),
    ("ubuntu-font", "ubuntu", "ubuntu font licen[cs]e"),
    ("free-art", "art", "(?:free art license|licence art libre)"),
    ("dsl", "design", "design science license"),
    ("opl-1.0", "publication", "open publication license"),
    ("openrail", "openrail", "(?:creativeml |bigscience )?openrail(?: m)? license"),
    ("rail", "responsible", "responsible ai license"),
    ("llama", "llama", "llama (?:2|3|3 1|3 2|3 3|4)? ?community license(?: agreement)?"),
    ("gemma", "gemma", "gemma terms of use"),
    # public domain, and none
    ("public-domain", "domain", "(?:released|placed|put|dedicated|is|are) (?:in ?to|in|to) the public domain"),
    ("public-domain", "domain", "this (?:file|code|software|work|text|book|image) is (?:in the )?public domain"),
    ("public-domain", "domain", "public domain no (?:rights|copyright) reserved"),
    ("public-domain", "ebook", "this ebook is for the use of anyone anywhere (?:in the united states and most other parts of the world )?at no cost"),
    ("proprietary", "rights", "all rights reserved"),
    ("proprietary", "confidential", "confidential and proprietary"),
    ("proprietary", "proprietary", "this software is (?:the )?(?:confidential and )?proprietary (?:information|property|to)"),
    ("proprietary", "trade", "contains? (?:confidential (?:information )?and )?trade secrets"),
    ("proprietary", "prohibited", "unauthori[sz]ed (?:copying|reproduction|use|distribution) (?:of this (?:file|material|software) )?(?:\\S+ ){0,8}(?:is )?(?:strictly )?prohibited"),
    ("proprietary", "reproduced", "no part of this (?:publication|book|document|work|site) may be reproduced"),
    ("proprietary", "rewritten", "may not be published broadcast rewritten or redistributed"),
    ("proprietary", "syndicated", "may not be syndicated without"),
    ("proprietary", "evaluation", "for evaluation purposes only"),
    ("proprietary", "agreement", "end user licen[cs]e agreement(?: eula)?"),
    ("non-commercial", "commercial", "(?:for )?(?:personal|academic|research|educational)(?: or (?:personal|academic|research|educational))?(?: and)? non commercial (?:use|purposes)(?: only)?"),
    ("non-commercial", "commercial", "commercial use (?:is )?(?:strictly )?(?:prohibited|forbidden|not (?:permitted|allowed))"),
    ("freeware", "freeware", "this (?:software|program) is freeware"),
    ("shareware", "shareware", "this (?:software|program) is shareware"),
)
