"""Signatures of licenses and notices, written by hand.

They are matched against a text's words in lower case with one blank between them, so a
pattern sees no punctuation: "Apache-2.0" is ``apache 2 0``. Each line holds

    label | kind | keyword | pattern

A pattern is tried only where its keyword occurs somewhere in the text, so the keyword must
occur in every text that the pattern accepts. The kind gives the
priority and the score: ``text`` (wording of a license), ``notice`` (grant of a license),
``tag`` (machine-readable identifier), ``name`` (a license by its name), ``clue`` (words
that only hint at one). ``{v}`` stands for the word "version" or "v", or nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Priority and score of each kind.
KINDS = {"text": (5, 1.0), "notice": (4, 0.95), "tag": (3, 0.9), "name": (2, 0.75), "clue": (1, 0.4)}

RULES_TEXT = r"""
apache-2.0 | notice | apache license | licensed under the apache license {v}2(?: 0)?(?: the license)?
apache-2.0 | notice | may not use this file except | you may not use this file except in compliance with the license
apache-2.0 | notice | apache org licenses license 2 0 | (?:https? )?(?:www )?apache org licenses license 2 0(?: txt| html)?
apache-2.0 | text | terms and conditions for use reproduction and distribution | apache license version 2 0 january 2004(?: \S+){0,8} terms and conditions for use reproduction and distribution
apache-2.0 | text | as is basis without warranties or conditions | distributed on an as is basis without warranties or conditions of any kind either express or implied
apache-2.0 | text | grant of patent license | grant of patent license subject to the terms and conditions of this license each contributor hereby grants
apache-2.0 | name | apache license | apache license {v}2(?: 0)?
apache-2.0 | name | apache 2 | apache 2(?: 0)?(?: license| licensed)
apache-2.0 | tag | apache 2 0 | spdx license identifier apache 2 0
apache-1.1 | name | apache software license | apache software license {v}1 1
apache-1.1 | tag | apache 1 1 | spdx license identifier apache 1 1
apache-1.0 | tag | apache 1 0 | spdx license identifier apache 1 0
apache | clue | apache software foundation | licensed to the apache software foundation asf under one or more contributor license agreements
mit | text | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)?
mit | text | the above copyright notice and this permission notice | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | text | the software is provided as is | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit | notice | mit license | (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of the )?mit license
mit | notice | mit licensed | (?:is|are) mit licensed
mit | name | the mit license | the mit license(?: mit)?
mit | name | mit license | mit license
mit | tag | identifier mit | spdx license identifier mit
mit | tag | license mit | license mit
mit-0 | text | without restriction including without limitation | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software
mit-0 | tag | mit 0 | spdx license identifier mit 0
mit-0 | name | mit no attribution | mit no attribution(?: license)?
x11 | name | x11 license | (?:the )?x11 license
x11 | text | x consortium | except as contained in this notice the name of the x consortium shall not be used in advertising
expat | name | expat license | (?:the )?expat license
isc | text | permission to use copy modify and | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
isc | text | the author disclaims all warranties | the software is provided as is and the author disclaims all warranties with regard to this software
isc | name | isc license | (?:the )?isc license
isc | tag | identifier isc | spdx license identifier isc
0bsd | tag | 0bsd | spdx license identifier 0bsd
0bsd | name | zero clause | (?:bsd zero clause|zero clause bsd)(?: license)?
0bsd | name | bsd zero clause | bsd zero clause license
bsd-3-clause | text | neither the name | neither the names? of (?:\S+ ){1,12}(?:nor|or) the names of (?:its|the|any) contributors may be used to endorse or promote products
bsd-3-clause | text | may not be used to endorse or promote products | names? of (?:\S+ ){1,8}may not be used to endorse or promote products derived from this software without specific prior written permission
bsd-3-clause | name | 3 clause bsd | (?:the )?3 clause bsd(?: license)?
bsd-3-clause | name | bsd 3 clause | bsd 3 clause(?: license)?
bsd-3-clause | name | new bsd license | (?:the )?new bsd license
bsd-3-clause | name | modified bsd license | (?:the )?modified bsd license
bsd-3-clause | name | revised bsd license | (?:the )?revised bsd license
bsd-3-clause | tag | bsd 3 clause | spdx license identifier bsd 3 clause
bsd-3-clause | notice | bsd style license | governed by a bsd style license that can be found in the license file
bsd-2-clause | text | redistributions of source code must retain | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd-2-clause | text | redistributions in binary form | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd-2-clause | name | bsd 2 clause | bsd 2 clause(?: license)?
bsd-2-clause | name | 2 clause bsd | (?:the )?2 clause bsd(?: license)?
bsd-2-clause | name | simplified bsd license | (?:the )?simplified bsd license
bsd-2-clause | name | freebsd license | (?:the )?freebsd license
bsd-2-clause | tag | bsd 2 clause | spdx license identifier bsd 2 clause
bsd-4-clause | text | all advertising materials mentioning features | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-4-clause | name | bsd 4 clause | (?:spdx license identifier )?bsd 4 clause
bsd-4-clause | name | original bsd license | (?:the )?original bsd license
bsd | notice | bsd license | (?:licensed|released|distributed|available|provided) under (?:the |a )?(?:terms of the )?bsd license
bsd | name | bsd license | bsd license
bsd | name | bsd style license | bsd style license
gpl-3.0 | notice | general public license | licensed under the (?:terms of the )?gnu general public license {v}3(?: 0)?
gpl-3.0 | notice | gnu general public license | gnu general public license as published by the free software foundation (?:either )?version 3 of the license
gpl-3.0 | name | general public license | (?:gnu )?general public license {v}3(?: 0)?
gpl-3.0 | name | gpl | gpl ?{v}3(?: 0)?
gpl-3.0 | name | gplv3 | (?:gnu )?gplv3
gpl-3.0 | tag | gpl 3 0 | spdx license identifier gpl 3 0 only
gpl-3.0-or-later | tag | gpl 3 0 or later | spdx license identifier gpl 3 0 or later
gpl-3.0-or-later | notice | version 3 of the license or | gnu general public license (?:\S+ ){0,12}version 3 of the license or at your option any later version
gpl-3.0-or-later | name | gplv3 or later | gplv3 or later
gpl-3.0 | text | gnu general public license version 3 29 june 2007 | gnu general public license version 3 29 june 2007
gpl-2.0 | notice | general public license | licensed under the (?:terms of the )?gnu general public license {v}2(?: 0)?
gpl-2.0 | notice | gnu general public license | gnu general public license as published by the free software foundation (?:either )?version 2 of the license
gpl-2.0 | name | general public license | (?:gnu )?general public license {v}2(?: 0)?
gpl-2.0 | name | gplv2 | (?:gnu )?gplv2
gpl-2.0 | tag | gpl 2 0 | spdx license identifier gpl 2 0(?: only)?
gpl-2.0-or-later | tag | gpl 2 0 or later | spdx license identifier gpl 2 0 or later
gpl-2.0-or-later | notice | version 2 of the license or | gnu general public license (?:\S+ ){0,12}version 2 of the license or at your option any later version
gpl-2.0-or-later | name | gplv2 or later | gplv2 or later
gpl-2.0 | text | gnu general public license version 2 june 1991 | gnu general public license version 2 june 1991
gpl-1.0 | tag | gpl 1 0 | spdx license identifier gpl 1 0(?: only| or later)?
gpl | notice | free software you can redistribute it | this (?:program|file|library|software) is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl | text | you should have received a copy of the gnu general public license | you should have received a copy of the gnu general public license along with
gpl | name | gnu general public license | gnu general public license
gpl | name | gnu gpl | (?:the )?gnu gpl
gpl | clue | gnu org licenses gpl | gnu org licenses gpl(?: html| txt)?
classpath-exception | notice | classpath exception | (?:with )?(?:the )?(?:gnu )?classpath exception(?: 2 0)?
classpath-exception | text | linking this library statically or dynamically | linking this library statically or dynamically with other modules is making a combined work based on this library
gcc-exception | notice | gcc runtime library exception | gcc runtime library exception(?: {v}3 1)?
lgpl-3.0 | notice | lesser general public license | gnu lesser general public license (?:\S+ ){0,12}version 3(?: 0)?
lgpl-3.0 | name | lgplv3 | (?:gnu )?lgplv3
lgpl-3.0 | tag | lgpl 3 0 | spdx license identifier lgpl 3 0(?: only| or later)?
lgpl-2.1 | notice | lesser general public license | gnu lesser general public license (?:\S+ ){0,12}version 2 1
lgpl-2.1 | name | lgpl | lgpl ?{v}2 1
lgpl-2.1 | tag | lgpl 2 1 | spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-2.0 | notice | library general public license | gnu library general public license(?: {v}2(?: 0)?)?
lgpl-2.0 | tag | lgpl 2 0 | spdx license identifier lgpl 2 0(?: only| or later)?
lgpl | name | lesser general public license | (?:gnu )?lesser general public license
lgpl | name | gnu lgpl | (?:the )?gnu lgpl
agpl-3.0 | notice | affero general public license | gnu affero general public license (?:\S+ ){0,12}version 3(?: 0)?
agpl-3.0 | name | agplv3 | (?:gnu )?agplv3
agpl-3.0 | tag | agpl 3 0 | spdx license identifier agpl 3 0(?: only| or later)?
agpl | name | affero general public license | (?:gnu )?affero general public license
gfdl-1.3 | notice | free documentation license | gnu free documentation license {v}1 3
gfdl-1.2 | notice | free documentation license | gnu free documentation license {v}1 2
gfdl | notice | permission is granted to copy distribute and or modify this document | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl | name | free documentation license | (?:gnu )?free documentation license
mpl-2.0 | notice | mozilla public license | subject to the terms of the mozilla public license {v}2 0
mpl-2.0 | notice | copy of the mpl was not distributed | if a copy of the mpl was not distributed with this file you can obtain one at
mpl-2.0 | name | mozilla public license | mozilla public license {v}2(?: 0)?
mpl-2.0 | tag | mpl 2 0 | spdx license identifier mpl 2 0
mpl-1.1 | notice | mozilla public license | subject to the mozilla public license version 1 1
mpl-1.1 | name | mozilla public license | mozilla public license {v}1 1
mpl-1.1 | tag | mpl 1 1 | spdx license identifier mpl 1 1
mpl | name | mozilla public license | mozilla public license
epl-2.0 | notice | eclipse public license | (?:made available|distributed|licensed) under the (?:terms of the )?eclipse public license {v}2(?: 0)?
epl-2.0 | name | eclipse public license | eclipse public license {v}2(?: 0)?
epl-2.0 | tag | epl 2 0 | spdx license identifier epl 2 0
epl-1.0 | name | eclipse public license | eclipse public license {v}1(?: 0)?
epl-1.0 | tag | epl 1 0 | spdx license identifier epl 1 0
epl | name | eclipse public license | eclipse public license
edl-1.0 | name | eclipse distribution license | eclipse distribution license(?: {v}1(?: 0)?)?
cddl-1.0 | name | common development and distribution license | common development and distribution license(?: cddl)?(?: {v}1 0)?
cddl-1.1 | name | common development and distribution license | common development and distribution license(?: cddl)? {v}1 1
cddl-1.0 | tag | cddl 1 0 | spdx license identifier cddl 1 0
cddl | name | cddl | cddl license
cpl-1.0 | name | common public license | common public license(?: {v}1 0)?
ipl-1.0 | name | ibm public license | ibm public license(?: {v}1 0)?
apsl-2.0 | name | apple public source license | apple public source license(?: {v}2 0)?
artistic-2.0 | name | artistic license | (?:the )?artistic license {v}2(?: 0)?
artistic-2.0 | tag | artistic 2 0 | spdx license identifier artistic 2 0
artistic-1.0 | name | artistic license | (?:the )?(?:perl )?artistic license {v}1(?: 0)?
artistic | name | artistic license | (?:the )?(?:perl )?artistic license
perl | notice | same terms as perl | (?:under|on) the same terms as perl(?: itself)?
zlib | text | altered source versions must be plainly marked | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib | text | the origin of this software must not be misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | name | zlib license | (?:the )?zlib license
zlib | tag | identifier zlib | spdx license identifier zlib
libpng | name | png | (?:the )?(?:png reference library|libpng) license(?: {v}2)?
bsl-1.0 | notice | boost software license | (?:distributed|licensed|released) under the boost software license {v}1 0
bsl-1.0 | name | boost software license | boost software license(?: {v}1 0)?
bsl-1.0 | tag | bsl 1 0 | spdx license identifier bsl 1 0
busl-1.1 | name | business source license | business source license(?: {v}1 1)?
busl-1.1 | tag | busl 1 1 | spdx license identifier busl 1 1
sspl-1.0 | name | server side public license | server side public license(?: {v}1)?
elastic-2.0 | name | elastic license | elastic license(?: {v}2(?: 0)?)?
commons-clause | notice | commons clause | commons clause(?: license)?(?: condition)?
polyform-noncommercial | name | polyform noncommercial | polyform noncommercial license(?: 1 0 0)?
unlicense | text | free and unencumbered software | this is free and unencumbered software released into the public domain
unlicense | name | the unlicense | the unlicense
unlicense | tag | identifier unlicense | spdx license identifier unlicense
wtfpl | name | do what the fuck you want | do what the fuck you want to public license(?: {v}2)?
wtfpl | tag | wtfpl | spdx license identifier wtfpl
beerware | text | beer ware license | (?:the )?beer ware license
public-domain | notice | public domain | (?:released|placed|dedicated|put|is|are) (?:in|into|to) the public domain
public-domain | clue | public domain | public domain
ofl-1.1 | notice | sil open font license | licensed under the sil open font license(?: {v}1 1)?
ofl-1.1 | name | open font license | (?:sil )?open font license(?: {v}1 1)?
ofl-1.1 | tag | ofl 1 1 | spdx license identifier ofl 1 1
cc0-1.0 | notice | cc0 | (?:licensed|released|available|dedicated) (?:under|to|with) (?:the )?(?:creative commons )?cc0(?: 1 0)?(?: universal)?
cc0-1.0 | name | cc0 | cc0 1 0(?: universal)?
cc0-1.0 | name | creative commons zero | creative commons zero(?: {v}1 0)?(?: universal)?
cc0-1.0 | tag | publicdomain zero 1 0 | creativecommons org publicdomain zero 1 0
cc-by-4.0 | notice | creative commons attribution 4 0 | creative commons attribution 4 0(?: international)?(?: public)?(?: license)?
cc-by-4.0 | name | cc by 4 0 | cc by 4 0
cc-by-4.0 | tag | licenses by 4 0 | creativecommons org licenses by 4 0
cc-by-3.0 | notice | creative commons attribution 3 0 | creative commons attribution 3 0(?: unported)?(?: license)?
cc-by-3.0 | name | cc by 3 0 | cc by 3 0
cc-by-3.0 | tag | licenses by 3 0 | creativecommons org licenses by 3 0
cc-by-2.0 | name | cc by 2 | cc by 2 [05]
cc-by-sa-4.0 | notice | attribution sharealike 4 0 | creative commons attribution sharealike 4 0(?: international)?(?: license)?
cc-by-sa-4.0 | notice | attribution share alike 4 0 | creative commons attribution share alike 4 0(?: international)?(?: license)?
cc-by-sa-4.0 | name | cc by sa 4 0 | cc by sa 4 0
cc-by-sa-4.0 | tag | licenses by sa 4 0 | creativecommons org licenses by sa 4 0
cc-by-sa-3.0 | notice | attribution sharealike 3 0 | creative commons attribution sharealike 3 0(?: unported)?(?: license)?
cc-by-sa-3.0 | name | cc by sa 3 0 | cc by sa 3 0
cc-by-sa-3.0 | tag | licenses by sa 3 0 | creativecommons org licenses by sa 3 0
cc-by-sa | name | cc by sa | cc by sa
cc-by-sa | name | attribution sharealike | creative commons attribution sharealike
cc-by-nc-4.0 | notice | attribution noncommercial 4 0 | creative commons attribution noncommercial 4 0(?: international)?(?: license)?
cc-by-nc-4.0 | name | cc by nc 4 0 | cc by nc 4 0
cc-by-nc-4.0 | tag | licenses by nc 4 0 | creativecommons org licenses by nc 4 0
cc-by-nc-sa-4.0 | notice | attribution noncommercial sharealike 4 0 | creative commons attribution noncommercial sharealike 4 0(?: international)?(?: license)?
cc-by-nc-sa-4.0 | name | cc by nc sa 4 0 | cc by nc sa 4 0
cc-by-nc-sa-4.0 | tag | licenses by nc sa 4 0 | creativecommons org licenses by nc sa 4 0
cc-by-nc-sa-3.0 | name | cc by nc sa 3 0 | cc by nc sa 3 0
cc-by-nc-sa | name | cc by nc sa | cc by nc sa
cc-by-nc-nd-4.0 | notice | attribution noncommercial noderivatives 4 0 | creative commons attribution noncommercial noderivatives 4 0(?: international)?(?: license)?
cc-by-nc-nd-4.0 | name | cc by nc nd 4 0 | cc by nc nd 4 0
cc-by-nc-nd-3.0 | name | cc by nc nd 3 0 | cc by nc nd 3 0
cc-by-nc-nd | name | cc by nc nd | cc by nc nd
cc-by-nc | name | cc by nc | cc by nc
cc-by-nd-4.0 | name | cc by nd 4 0 | cc by nd 4 0
cc-by-nd | name | cc by nd | cc by nd
cc-by | notice | creative commons attribution | (?:licensed|released|available) under (?:a |the )?creative commons attribution(?: license)?
cc-by | name | creative commons attribution | creative commons attribution license
cc-by | name | cc by | cc by
creative-commons | clue | creative commons | creative commons(?: license| licence)?
odbl-1.0 | name | open database license | open database license(?: {v}1 0)?(?: odbl)?
odc-by-1.0 | name | open data commons attribution | open data commons attribution license(?: {v}1 0)?
pddl-1.0 | name | public domain dedication and license | (?:open data commons )?public domain dedication and license
cdla-permissive | name | community data license agreement permissive | community data license agreement permissive(?: {v}[12] 0)?
cdla-sharing | name | community data license agreement sharing | community data license agreement sharing(?: {v}1 0)?
ogl-uk-3.0 | name | open government licence | open government licence(?: {v}3 0)?
etalab-2.0 | name | licence ouverte | licence ouverte(?: {v}2 0)?
dl-de-by-2.0 | name | datenlizenz deutschland | datenlizenz deutschland namensnennung(?: {v}2 0)?
psf-2.0 | name | python software foundation license | python software foundation license(?: {v}2)?
python-2.0 | text | psf is making python available | psf is making python available to licensee on an as is basis
php-3.01 | name | php license | (?:the )?php license(?: {v}3 01)?
ruby | name | ruby license | (?:the )?ruby license
openssl | text | openssl project | this product includes software developed by the openssl project for use in the openssl toolkit
openssl | name | openssl license | (?:the )?openssl license
ssleay | text | cryptographic software written by eric young | this product includes cryptographic software written by eric young
curl | name | curl license | (?:the )?curl license
postgresql | name | postgresql license | (?:the )?postgresql license
ncsa | name | ncsa open source license | (?:university of illinois )?(?:ncsa )?ncsa open source license
llvm-exception | notice | llvm exception | (?:with )?llvm exceptions?
ms-pl | name | microsoft public license | microsoft public license(?: ms pl)?
ms-rl | name | microsoft reciprocal license | microsoft reciprocal license(?: ms rl)?
eupl-1.2 | name | european union public licen | european union public licen[cs]e(?: {v}1 2)?
eupl-1.2 | tag | eupl 1 2 | spdx license identifier eupl 1 2
cecill-2.1 | name | cecill | (?:licence |license )?cecill(?: {v}2 1)?
osl-3.0 | name | open software license | open software license(?: {v}3 0)?
afl-3.0 | name | academic free license | academic free license(?: {v}3 0)?
ecl-2.0 | name | educational community license | educational community license(?: {v}2 0)?
upl-1.0 | name | universal permissive license | universal permissive license(?: {v}1 0)?
bluoak-1.0 | name | blue oak model license | blue oak model license(?: 1 0 0)?
vim | name | vim license | (?:the )?vim license
w3c | name | w3c software | w3c software (?:and document )?(?:notice and )?license
w3c | text | w3c document license | w3c document license
unicode | name | unicode license | unicode license(?: {v}3)?
unicode | notice | unicode terms of use | unicode terms of use
json | text | used for good not evil | the software shall be used for good not evil
openrail | name | rail | (?:creativeml |bigscience |bigcode )?open ?rail(?: m)?(?: license)?
proprietary | notice | proprietary and confidential | (?:is |are )?proprietary and confidential
proprietary | notice | unauthorized copying of this file | unauthorized copying of this file via any medium is strictly prohibited
proprietary | notice | trade secret | (?:contains|constitutes) (?:\S+ ){0,4}trade secrets?
proprietary | notice | may not be reproduced | may not be reproduced (?:\S+ ){0,8}without (?:the )?(?:prior )?(?:express )?(?:written )?(?:permission|consent)
proprietary | notice | end user license agreement | end user license agreement
reserved | notice | all rights reserved | copyright (?:c )?(?:\S+ ){0,10}all rights reserved
reserved | name | all rights reserved | all rights reserved
reserved | name | tous droits | tous droits (?:de reproduction )?réservés
reserved | name | alle rechte vorbehalten | alle rechte vorbehalten
reserved | name | todos los derechos reservados | todos los derechos reservados
copyright | clue | copyright | copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)*
license-file | clue | the license file | (?:see|read) the license file(?: for (?:details|more information))?
license-file | clue | see licen | see licen[cs]e in (?:the )?(?:file|root|repository)
license-tag | clue | spdx license identifier | spdx license identifier (?:\S+ )?\S+
"""


@dataclass(frozen=True)
class Rule:
    label: str
    kind: str
    keyword: str
    pattern: re.Pattern[bytes]

    @property
    def priority(self) -> int:
        return KINDS[self.kind][0]

    @property
    def score(self) -> float:
        return KINDS[self.kind][1]


def load(text: str = RULES_TEXT) -> list[Rule]:
    """The rules of a table, in its order; patterns match whole words of joined bytes."""
    rules = []
    for line in filter(None, map(str.strip, text.splitlines())):
        label, kind, keyword, pattern = (part.strip() for part in line.split(" | ", 3))
        pattern = pattern.replace("{v}", "(?:version |v ?)?")
        rules.append(Rule(label, kind, keyword, re.compile(b"(?<= )(?:" + pattern.encode() + b")(?= )")))
    return rules
