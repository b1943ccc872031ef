"""Licence scans by sentence rules.

A text is cut into sentences, each sentence normalised (lower case, "licence" spelled "license", all but letters a-z and
digits one space) and looked up among the known licence sentences. The identifiers found, in text order, form a sequence
such as ``<mit-grant><mit-notice><as-is>``; the rules, ordered from the most specific, each replace their run of identifiers
by a licence name, so that an identifier counts for one licence only. A full text is known by the sentences that set it apart (short texts by all of theirs), and
a notice by its own.

Sentences are cut twice, since licence texts are often wrapped and often stand on a line of their own after an unfinished one:
once with every line end as a sentence end, once with only blank lines as such. Both keep the offsets of the text. A sentence
that begins before the end of an earlier known one is dropped. ``<>`` in the sequence says that more than ``reach``
characters stand between two known sentences; no rule reaches across it.

Only texts with a word of TRIGGERS go to Python; every known sentence has such a word, so none is lost. There is no shuffle.

Defined results: a null or empty text and a text without known sentences have no licences, empty strings and 0; a very long text takes memory in
proportion to its length; of sentences that begin at one place the longest counts; repeated rows and null keys have rows of their own; an empty table gives no rows. Only key and text are read.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words of which every known sentence has one.
TRIGGERS = [
    "licen[cs]e", "copyright", "permission", "permitted", "redistribut", "warrant", "liable", "endorse", "public domain", "free software",
    "released under", "distributed under", "available under", "published under", "provided under", "under the terms", "to the terms", "all rights reserved",
    "the mpl", "conditions for use", "modified files", "advertising materials", "theory of liability", "loss of use", "removed or altered", "anyone is free",
]

# Ways to refer to a licence by name, and the names (normalised).
LEADS = [
    "licensed under", "released under", "distributed under", "available under", "published under", "provided under", "license", "spdx license identifier",
    "licensed under the terms of", "released under the terms of", "distributed under the terms of", "subject to the terms of", "see the license",
]
SUBJECTS = ["", "this work is", "this software is", "this program is", "this file is", "this project is", "this document is", "this code is"]
NAMES = {
    "MIT": ["mit license", "mit", "expat license"],
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache 2 0"],
    "GPL-2.0": ["gnu general public license version 2", "gnu general public license v2", "gnu general public license v2 0", "gnu gpl version 2", "gpl version 2", "gpl v2", "gplv2", "gpl 2 0", "gpl 2 0 only"],
    "GPL-3.0": ["gnu general public license version 3", "gnu general public license v3", "gnu general public license v3 0", "gnu gpl version 3", "gpl version 3", "gpl v3", "gplv3", "gpl 3 0", "gpl 3 0 only"],
    "LGPL-2.1": ["gnu lesser general public license version 2 1", "lgpl version 2 1", "lgpl v2 1", "lgpl 2 1", "lgpl 2 1 only"],
    "LGPL-3.0": ["gnu lesser general public license version 3", "lgpl version 3", "lgpl v3", "lgpl 3 0", "lgpl 3 0 only"],
    "AGPL-3.0": ["gnu affero general public license version 3", "agpl version 3", "agpl v3", "agpl 3 0", "agpl 3 0 only"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license 2 0", "mpl 2 0"],
    "BSD-2-Clause": ["bsd 2 clause license", "bsd 2 clause", "simplified bsd license"],
    "BSD-3-Clause": ["bsd 3 clause license", "bsd 3 clause", "new bsd license", "modified bsd license"],
    "ISC": ["isc license", "isc"],
    "Unlicense": ["unlicense"],
    "CC0-1.0": ["cc0", "cc0 1 0", "creative commons zero"],
    "CC-BY-4.0": ["cc by 4 0", "creative commons attribution 4 0 international license"],
    "CC-BY-SA-4.0": ["cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"],
    "CC-BY-NC-4.0": ["cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"],
    "CC-BY-ND-4.0": ["cc by nd 4 0", "creative commons attribution noderivatives 4 0 international license"],
    "BSD-4-Clause": ["bsd 4 clause license", "bsd 4 clause", "original bsd license"],
    "Zlib": ["zlib license", "zlib"],
    "BSL-1.0": ["boost software license version 1 0", "boost software license 1 0", "bsl 1 0"],
    "EPL-1.0": ["eclipse public license version 1 0", "eclipse public license v1 0", "epl 1 0"],
    "EPL-2.0": ["eclipse public license version 2 0", "eclipse public license 2 0", "eclipse public license v2 0", "epl 2 0"],
    "Artistic-1.0": ["artistic license 1 0", "artistic 1 0"],
    "Artistic-2.0": ["artistic license 2 0", "artistic 2 0"],
    "0BSD": ["0bsd", "bsd zero clause license", "zero clause bsd"],
    "WTFPL": ["wtfpl"],
    "CC-BY-NC-ND-4.0": ["cc by nc nd 4 0", "creative commons attribution noncommercial noderivatives 4 0 international license"],
    "CC-BY-NC-SA-4.0": ["cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0 international license"],
}

# Sentences of licence texts (normalised) and their identifiers.
SENTENCES = {
    "mit license": "title:MIT",
    "the mit license": "title:MIT",
    "the mit license mit": "title:MIT",
    "isc license": "title:ISC",
    "all rights reserved": "all-rights",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-as-is",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-as-is",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-as-is",
    "licensed under the apache license version 2 0 the license": "apache-head",
    "you may not use this file except in compliance with the license": "apache-comply",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache-copy",
    "you may obtain a copy of the license at": "apache-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-as-is",
    "see the license for the specific language governing permissions and limitations under the license": "apache-see",
    "this program is free software": "gnu-free",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-terms",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl-terms",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation": "agpl-terms",
    "either version 2 of the license or at your option any later version": "gnu-2-later",
    "either version 2 1 of the license or at your option any later version": "gnu-2.1-later",
    "either version 3 of the license or at your option any later version": "gnu-3-later",
    "this program is distributed in the hope that it will be useful but without any warranty": "gnu-hope",
    "this library is distributed in the hope that it will be useful but without any warranty": "gnu-hope",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "gnu-implied",
    "see the gnu general public license for more details": "gpl-details",
    "see the gnu lesser general public license for more details": "lgpl-details",
    "see the gnu affero general public license for more details": "agpl-details",
    "you should have received a copy of the gnu general public license along with this program": "gpl-received",
    "you should have received a copy of the gnu lesser general public license along with this library": "lgpl-received",
    "you should have received a copy of the gnu affero general public license along with this program": "agpl-received",
    "if not see http www gnu org licenses": "gnu-see",
    "if not see https www gnu org licenses": "gnu-see",
    "this library is free software": "gnu-free",
    "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed": "gnu-verbatim",
    "gnu general public license": "title:GPL",
    "gnu lesser general public license": "title:LGPL",
    "gnu affero general public license": "title:AGPL",
    "the gnu general public license is a free copyleft license for software and other kinds of works": "gpl3-preamble",
    "the licenses for most software are designed to take away your freedom to share and change it": "gpl2-preamble",
    "the licenses for most software and other practical works are designed to take away your freedom to share and change the works": "gpl3-practical",
    "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software": "agpl3-preamble",
    "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below": "lgpl3-body",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-form",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-notice",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3-notice",
    "this source code form is subject to the terms of the mozilla public license v": "mpl-form",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl-copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl-copy",
    "this source code form is incompatible with secondary licenses as defined by the mozilla public license v 2 0": "mpl-incompatible",
    "terms and conditions for use reproduction and distribution": "apache-terms",
    "license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document": "apache-license-means",
    "licensor shall mean the copyright owner or entity authorized by the copyright owner that is granting the license": "apache-licensor-means",
    "you must give any other recipients of the work or derivative works a copy of this license": "apache-give",
    "you must cause any modified files to carry prominent notices stating that you changed the files": "apache-changed",
    "unless required by applicable law or agreed to in writing licensor provides the work and each contributor provides its contributions on an as is basis without warranties or conditions of any kind either express or implied including without limitation any warranties or conditions of title non infringement merchantability or fitness for a particular purpose": "apache-disclaimer",
    "apache license": "title:Apache",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd-advertising",
    "neither the name of the copyright holders nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "neither the name of the university nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services": "bsd-liability",
    "in no event shall the copyright owner or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services": "bsd-liability",
    "loss of use data or profits": "bsd-loss",
    "or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "bsd-theory",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so": "mit-grant-0",
    "except as contained in this notice the name of the copyright holders shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization": "x11-name",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software": "isc-liability",
    "this software is provided as is without any express or implied warranty": "zlib-as-is",
    "in no event will the authors be held liable for any damages arising from the use of this software": "zlib-liability",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "this notice may not be removed or altered from any source distribution": "zlib-notice",
    "boost software license version 1 0 august 17th 2003": "title:BSL-1.0",
    "boost software license version 1 0": "title:BSL-1.0",
    "distributed under the boost software license version 1 0": "boost-head",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "boost-grant",
    "the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor": "boost-notice",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html": "epl1-head",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl2-head",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at http www eclipse org legal epl 2 0": "epl2-head",
    "the accompanying program is provided under the terms of this eclipse public license agreement": "epl-agreement",
    "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed": "wtfpl-verbatim",
    "do what the fuck you want to public license": "wtfpl-title",
    "this is free software under the terms of the artistic license": "artistic-head",
    "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control over the development of the package while giving the users of the package the right to use and distribute the package in a more or less customary fashion plus the right to make reasonable modifications": "artistic1-intent",
    "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed": "artistic2-establishes",
    "you are permitted to use the standard version and create and use modified versions for any purpose without restriction provided that you do not distribute the modified version": "artistic2-permission",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-free",
    "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain": "unlicense-dedicate",
    "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work": "cc0-waived",
    "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law including all related and neighboring rights to the extent allowed by law": "cc0-deed",
    "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution 4 0 international public license public license": "cc-by-4-body",
    "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution sharealike 4 0 international public license public license": "cc-by-sa-4-body",
    "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution noncommercial 4 0 international public license public license": "cc-by-nc-4-body",
    "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution noderivatives 4 0 international public license public license": "cc-by-nd-4-body",
    "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution noncommercial sharealike 4 0 international public license public license": "cc-by-nc-sa-4-body",
    "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution noncommercial noderivatives 4 0 international public license public license": "cc-by-nc-nd-4-body",
    "this is free and unencumbered software released into the public domain": "unlicense-head",
    "this work is dedicated to the public domain": "public-domain",
    "this file is in the public domain": "public-domain",
}

# Rules in the order in which they are tried.
RULES = [
    ("mit-grant mit-notice mit-as-is mit-liability x11-name", "X11"),
    ("mit-grant mit-notice mit-as-is mit-liability", "MIT"),
    ("mit-grant mit-notice mit-as-is", "MIT"),
    ("mit-grant mit-notice", "MIT"),
    ("mit-grant-0 mit-as-is mit-liability", "MIT-0"),
    ("isc-grant isc-as-is isc-liability", "ISC"),
    ("0bsd-grant isc-as-is isc-liability", "0BSD"),
    ("isc-grant isc-as-is", "ISC"),
    ("isc-grant", "ISC"),
    ("bsd-grant bsd-source bsd-binary bsd-advertising bsd-endorse bsd-as-is bsd-liability bsd-loss bsd-theory", "BSD-4-Clause"),
    ("bsd-grant bsd-source bsd-binary bsd-advertising bsd-endorse", "BSD-4-Clause"),
    ("bsd-grant bsd-source bsd-binary bsd-endorse bsd-as-is bsd-liability bsd-loss bsd-theory", "BSD-3-Clause"),
    ("bsd-grant bsd-source bsd-binary bsd-as-is bsd-liability bsd-loss bsd-theory", "BSD-2-Clause"),
    ("bsd-grant bsd-source bsd-binary bsd-endorse bsd-as-is", "BSD-3-Clause"),
    ("bsd-grant bsd-source bsd-binary bsd-endorse", "BSD-3-Clause"),
    ("bsd-grant bsd-source bsd-binary bsd-as-is", "BSD-2-Clause"),
    ("bsd-grant bsd-source bsd-binary", "BSD-2-Clause"),
    ("apache-license-means apache-licensor-means", "Apache-2.0"),
    ("apache-give apache-changed", "Apache-2.0"),
    ("apache-disclaimer", "Apache-2.0"),
    ("apache-head apache-comply apache-copy apache-as-is apache-see", "Apache-2.0"),
    ("apache-head apache-comply apache-copy", "Apache-2.0"),
    ("apache-head", "Apache-2.0"),
    ("gnu-free gpl-terms gnu-2-later gnu-hope gnu-implied gpl-details gpl-received", "GPL-2.0-or-later"),
    ("gnu-free gpl-terms gnu-3-later gnu-hope gnu-implied gpl-details gpl-received", "GPL-3.0-or-later"),
    ("gnu-free lgpl-terms gnu-2.1-later gnu-hope gnu-implied lgpl-details lgpl-received", "LGPL-2.1-or-later"),
    ("gnu-free lgpl-terms gnu-3-later gnu-hope gnu-implied lgpl-details lgpl-received", "LGPL-3.0-or-later"),
    ("gnu-free agpl-terms gnu-3-later gnu-hope gnu-implied agpl-details agpl-received", "AGPL-3.0-or-later"),
    ("gpl3-notice gnu-hope gnu-implied gpl-details gpl-received", "GPL-3.0-or-later"),
    ("lgpl3-notice gnu-hope gnu-implied lgpl-details lgpl-received", "LGPL-3.0-or-later"),
    ("agpl3-notice gnu-hope gnu-implied agpl-details agpl-received", "AGPL-3.0-or-later"),
    ("gpl3-notice", "GPL-3.0-or-later"),
    ("lgpl3-notice", "LGPL-3.0-or-later"),
    ("agpl3-notice", "AGPL-3.0-or-later"),
    ("gnu-verbatim gpl2-preamble", "GPL-2.0"),
    ("gnu-verbatim gpl3-preamble", "GPL-3.0"),
    ("gnu-verbatim agpl3-preamble", "AGPL-3.0"),
    ("gnu-verbatim lgpl3-body", "LGPL-3.0"),
    ("gpl2-preamble", "GPL-2.0"),
    ("gpl3-preamble gpl3-practical", "GPL-3.0"),
    ("gpl3-preamble", "GPL-3.0"),
    ("agpl3-preamble", "AGPL-3.0"),
    ("lgpl3-body", "LGPL-3.0"),
    ("gnu-free gpl-terms gnu-2-later", "GPL-2.0-or-later"),
    ("gnu-free gpl-terms gnu-3-later", "GPL-3.0-or-later"),
    ("gnu-free lgpl-terms gnu-2.1-later", "LGPL-2.1-or-later"),
    ("gnu-free lgpl-terms gnu-3-later", "LGPL-3.0-or-later"),
    ("gnu-free agpl-terms gnu-3-later", "AGPL-3.0-or-later"),
    ("gnu-free gpl-terms", "GPL"),
    ("mpl-form mpl-copy", "MPL-2.0"),
    ("mpl-form", "MPL-2.0"),
    ("zlib-as-is zlib-liability zlib-grant", "Zlib"),
    ("boost-grant boost-notice", "BSL-1.0"),
    ("boost-head", "BSL-1.0"),
    ("epl1-head", "EPL-1.0"),
    ("epl2-head", "EPL-2.0"),
    ("wtfpl-title wtfpl-verbatim", "WTFPL"),
    ("artistic1-intent", "Artistic-1.0"),
    ("artistic2-establishes artistic2-permission", "Artistic-2.0"),
    ("artistic2-establishes", "Artistic-2.0"),
    ("unlicense-head unlicense-free unlicense-dedicate", "Unlicense"),
    ("unlicense-head unlicense-free", "Unlicense"),
    ("unlicense-head", "Unlicense"),
    ("cc0-waived", "CC0-1.0"),
    ("cc0-deed", "CC0-1.0"),
    ("cc-by-4-body", "CC-BY-4.0"),
    ("cc-by-sa-4-body", "CC-BY-SA-4.0"),
    ("cc-by-nc-4-body", "CC-BY-NC-4.0"),
    ("cc-by-nd-4-body", "CC-BY-ND-4.0"),
    ("cc-by-nc-sa-4-body", "CC-BY-NC-SA-4.0"),
    ("cc-by-nc-nd-4-body", "CC-BY-NC-ND-4.0"),
    ("public-domain", "Public-Domain"),
]


def known_sentences() -> dict[str, str]:
    """Normalised sentence -> identifier: the sentences of licence texts and every reference by lead and name."""
    refs = {}
    for name, aliases in NAMES.items():
        for alias in aliases:
            for lead in LEADS:
                for subject in SUBJECTS if lead.endswith("under") or lead.endswith("terms of") else [""]:
                    for article in ("", "the ", "a "):
                        refs[f"{subject} {lead} {article}{alias}".strip()] = f"name:{name}"
    return refs | SENTENCES


def rules() -> list[tuple[str, str]]:
    """(run of identifiers, licence), a reference or title by name last."""
    named = [(f"{kind}:{name}", name) for kind in ("name", "title") for name in NAMES]
    return [("".join(f"<{i}>" for i in ids.split()), name) for ids, name in RULES + named]


ENDS = re.compile(r"([.!?;])[ \t\r\n]|(:)\n")
#: A line of at most ten marks, as of a comment, counts as blank.
BLANK = re.compile("\n([^A-Za-z0-9\n]{0,10}\n)")
TRIGGER = re.compile("(?i)" + "|".join(t.replace(" ", r"[^a-z0-9]+") for t in TRIGGERS))
#: A copyright line: the holder is free, a year must follow.
COPYRIGHT = re.compile(r"(portions )?copyright (c )?[0-9]{4}( .*)?")


def normalised(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower().replace("licence", "license")).strip()


def sequence(text: str, known: dict[str, str], reach: int) -> str:
    """The identifiers of a text's known sentences, as ``<id>`` each, with ``<>`` between distant ones."""
    text = ENDS.sub(r"\1\2" + "\1", text)
    found = set()
    for cut in (text.replace("\n", "\1"), BLANK.sub("\1" + r"\1", text).replace("\n", " ")):
        start = 0
        for piece in cut.split("\1"):
            if TRIGGER.search(piece):
                plain = normalised(piece)
                name = known.get(plain) or ("copyright" if COPYRIGHT.fullmatch(plain) else None)
                if name:
                    found.add((start, -start - len(piece), name))
            start += len(piece) + 1
    out, end, last = [], 0, None
    for start, minus_end, name in sorted(found):
        if start >= end:
            out += ["<>"] * (last is not None and start - last > reach) + [f"<{name}>"]
            last = -minus_end
        end = max(end, -minus_end)
    return "".join(out)


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text", reach: int = 16) -> DataFrame:
    """key, licenses (distinct names in text order, joined by a comma), sequence, n_known (known sentences) and unclaimed
    (identifiers that no rule took, without copyright lines)."""
    known = known_sentences()

    @F.pandas_udf("string")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sequence(t, known, reach) if t else "")

    body = F.col(text).cast("string")
    rows = docs.select(F.col(key).alias("key"), F.coalesce(found(F.when(body.rlike(TRIGGER.pattern), body)), F.lit("")).alias("sequence"))
    rest = F.col("sequence")
    for run, name in rules():
        rest = F.replace(rest, F.lit(run), F.lit(f"[{name}]"))
    rows = rows.withColumn("rest", rest)
    names = F.array_distinct(F.regexp_extract_all("rest", F.lit(r"\[([^\]]+)\]"), F.lit(1)))
    left = F.regexp_extract_all("rest", F.lit("<([^>]+)>"), F.lit(1))
    return rows.select(
        F.col("key").alias(key), F.array_join(names, ",").alias("licenses"), "sequence", F.size(F.regexp_extract_all("sequence", F.lit("<([^>]+)>"), F.lit(1))).cast("long").alias("n_known"),
        F.array_join(F.filter(left, lambda i: i != "copyright"), ",").alias("unclaimed"),
    )


def oracle() -> str:
    """The scan of documents with the default reach, in SQL."""
    values = ", ".join(f"('{s}', '{i}')" for s, i in known_sentences().items())
    rest = "sequence"
    for run, name in rules():
        rest = f"replace({rest}, '{run}', '[{name}]')"
    return rf"""
        WITH known(sentence, id) AS (VALUES {values}),
        d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        marked AS (SELECT r, regexp_replace(text, '([.!?;])[ \t\r\n]|(:)\n', '\1\2' || chr(1), 'g') AS t FROM d WHERE regexp_matches(text, '{TRIGGER.pattern}')),
        cuts AS (SELECT r, 1 AS way, string_split(replace(t, chr(10), chr(1)), chr(1)) AS s FROM marked
            UNION ALL SELECT r, 2, string_split(replace(regexp_replace(t, '\n([^A-Za-z0-9\n]{{0,10}}\n)', chr(1) || '\1', 'g'), chr(10), ' '), chr(1)) FROM marked),
        pieces AS (SELECT r, way, unnest(s) AS p, unnest(range(len(s))) AS i FROM cuts),
        placed AS (SELECT r, p, CAST(sum(length(p) + 1) OVER (PARTITION BY r, way ORDER BY i) AS BIGINT) - 1 AS stop,
            trim(regexp_replace(replace(lower(p), 'licence', 'license'), '[^a-z0-9]+', ' ', 'g')) AS plain FROM pieces),
        found AS (SELECT DISTINCT r, stop - length(p) AS start, stop,
            coalesce(id, CASE WHEN regexp_full_match(plain, '{COPYRIGHT.pattern}') THEN 'copyright' END) AS id
            FROM placed LEFT JOIN known ON plain = sentence),
        alone AS (SELECT * FROM (SELECT *, max(stop) OVER (PARTITION BY r ORDER BY start, stop DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
            FROM found WHERE id IS NOT NULL) WHERE before IS NULL OR start >= before),
        gaps AS (SELECT *, start - lag(stop) OVER (PARTITION BY r ORDER BY start) > 16 AS far FROM alone),
        said AS (SELECT r, string_agg(CASE WHEN far THEN '<>' ELSE '' END || '<' || id || '>', '' ORDER BY start) AS sequence, count(*) AS n FROM gaps GROUP BY r),
        ruled AS (SELECT doc_id, coalesce(sequence, '') AS sequence, coalesce(n, 0) AS n_known, {rest} AS rest FROM d LEFT JOIN said USING (r)),
        listed AS (SELECT *, coalesce(regexp_extract_all(rest, '\[([^\]]+)\]', 1), []) AS names, coalesce(regexp_extract_all(rest, '<([^>]+)>', 1), []) AS ids FROM ruled)
        SELECT doc_id, array_to_string(list_filter(names, lambda x, i: list_position(names, x) = i), ',') AS licenses, sequence, CAST(n_known AS BIGINT) AS n_known,
            array_to_string(list_filter(ids, lambda x: x <> 'copyright'), ',') AS unclaimed
        FROM listed"""
