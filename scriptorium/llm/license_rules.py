"""Signature rules of the license scan, written by hand: three ordered tables, one rule a line, "label: expression".

An expression is a regular expression over lower-case words joined by one space. It starts with a plain word or two,
its keyword. Earlier rules win over later ones that find the same words at the same priority.
"""

import re

#: Priorities: a notice names no license, a family names one, an exact rule names its version or variant too.
NOTICE, FAMILY, EXACT = 1, 2, 3

EXACT_RULES = r"""
gpl-1.0: gnu general public license(?: as published by the free software foundation)?(?: version| v) ?1(?: 0)?
gpl-2.0-or-later: gnu general public license as published by the free software foundation either version 2 of the license or(?: at your option)? any later version
gpl-2.0-or-later: gnu general public license(?: version| v) ?2(?: 0)? or(?: at your option)?(?: any)? later
gpl-2.0-or-later: general public license(?: version| v) ?2(?: 0)? or(?: at your option)?(?: any)? later
gpl-2.0-or-later: gpl 2 0 or later
gpl-2.0-or-later: gplv2 or(?: any)? later
gpl-2.0-only: gnu general public license(?: version| v) ?2(?: 0)? only
gpl-2.0-only: gpl 2 0 only
gpl-2.0-only: gplv2 only
gpl-2.0: gnu general public license(?: as published by the free software foundation)?(?: version| v) ?2(?: 0)?
gpl-2.0: general public license(?: version| v) ?2(?: 0)?
gpl-2.0: gpl(?: version| v)? ?2(?: 0)?
gpl-2.0: gplv2
gpl-2.0-classpath: gpl 2 0 with classpath exception
gpl-2.0-classpath: gnu general public license(?: version| v) ?2(?: only)? with the classpath exception
gpl-3.0-or-later: gnu general public license as published by the free software foundation either version 3 of the license or(?: at your option)? any later version
gpl-3.0-or-later: gnu general public license(?: version| v) ?3(?: 0)? or(?: at your option)?(?: any)? later
gpl-3.0-or-later: general public license(?: version| v) ?3(?: 0)? or(?: at your option)?(?: any)? later
gpl-3.0-or-later: gpl 3 0 or later
gpl-3.0-or-later: gplv3 or(?: any)? later
gpl-3.0-only: gpl 3 0 only
gpl-3.0-only: gplv3 only
gpl-3.0: gnu general public license(?: as published by the free software foundation)?(?: version| v) ?3(?: 0)?
gpl-3.0: general public license(?: version| v) ?3(?: 0)?
gpl-3.0: gpl(?: version| v)? ?3(?: 0)?
gpl-3.0: gplv3
lgpl-2.0: gnu library general public license(?: version| v) ?2(?: 0)?
lgpl-2.1-or-later: gnu lesser general public license as published by the free software foundation either version 2 1 of the license or(?: at your option)? any later version
lgpl-2.1-or-later: lgpl 2 1 or later
lgpl-2.1-only: lgpl 2 1 only
lgpl-2.1: gnu lesser general public license(?: as published by the free software foundation)?(?: version| v) ?2 1
lgpl-2.1: lesser general public license(?: version| v) ?2 1
lgpl-2.1: lgpl(?: version| v)? ?2 1
lgpl-3.0-or-later: lgpl 3 0 or later
lgpl-3.0: gnu lesser general public license(?: as published by the free software foundation)?(?: version| v) ?3(?: 0)?
lgpl-3.0: lesser general public license(?: version| v) ?3(?: 0)?
lgpl-3.0: lgpl(?: version| v)? ?3(?: 0)?
agpl-3.0-or-later: gnu affero general public license as published by the free software foundation either version 3 of the license or(?: at your option)? any later version
agpl-3.0-or-later: agpl 3 0 or later
agpl-3.0-only: agpl 3 0 only
agpl-3.0: gnu affero general public license(?: version| v) ?3(?: 0)?
agpl-3.0: affero general public license(?: version| v) ?3(?: 0)?
agpl-3.0: agpl(?: version| v)? ?3(?: 0)?
agpl-1.0: affero general public license(?: version| v) ?1(?: 0)?
gfdl-1.1: gnu free documentation license(?: version| v) ?1 1
gfdl-1.2: gnu free documentation license(?: version| v) ?1 2(?: or any later version)?
gfdl-1.3: gnu free documentation license(?: version| v) ?1 3(?: or any later version)?
gfdl-1.3: gfdl 1 3
apache-1.0: apache(?: software)? license(?: version)? 1 0
apache-1.1: apache(?: software)? license(?: version)? 1 1
apache-2.0: apache(?: software)? license(?: version| v)? ?2(?: 0)?
apache-2.0: apache 2 0
apache-2.0: http www apache org licenses license 2 0
apache-2.0: https www apache org licenses license 2 0
apache-2.0: asl 2 0
apache-2.0: you may not use this file except in compliance with the license
apache-2.0: unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
mit: permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit: the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit: spdx license identifier mit
mit: license mit
mit: mit expat
mit-0: mit no attribution
mit-0: mit 0
bsd-0-clause: 0bsd
bsd-0-clause: zero clause bsd
bsd-1-clause: bsd 1 clause
bsd-2-clause: bsd 2 clause
bsd-2-clause: 2 clause bsd
bsd-2-clause: simplified bsd license
bsd-2-clause: freebsd license
bsd-3-clause: bsd 3 clause
bsd-3-clause: 3 clause bsd
bsd-3-clause: new bsd license
bsd-3-clause: modified bsd license
bsd-3-clause: revised bsd license
bsd-3-clause: neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
bsd-3-clause: neither the name of [a-z0-9 ]{1,60} nor the names of its contributors may be used
bsd-4-clause: bsd 4 clause
bsd-4-clause: original bsd license
bsd-4-clause: all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
isc: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc: permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted
isc: spdx license identifier isc
zlib: altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib: the origin of this software must not be misrepresented
mpl-1.0: mozilla public license(?: version| v)? ?1 0
mpl-1.1: mozilla public license(?: version| v)? ?1 1
mpl-1.1: mpl 1 1
mpl-2.0: mozilla public license(?: version| v)? ?2(?: 0)?
mpl-2.0: mpl(?: version| v)? ?2(?: 0)?
mpl-2.0: this source code form is subject to the terms of the mozilla public license
epl-1.0: eclipse public license(?: version| v)? ?1(?: 0)?
epl-1.0: epl 1 0
epl-2.0: eclipse public license(?: version| v)? ?2(?: 0)?
epl-2.0: epl 2 0
cddl-1.0: common development and distribution license(?: version)? ?1 0
cddl-1.0: cddl 1 0
cddl-1.1: cddl 1 1
eupl-1.1: european union public licen[cs]e(?: version| v)? ?1 1
eupl-1.2: european union public licen[cs]e(?: version| v)? ?1 2
eupl-1.2: eupl 1 2
artistic-1.0: artistic license 1 0
artistic-2.0: artistic license(?: version)? 2 0
osl-3.0: open software license(?: version| v)? ?3 0
osl-3.0: osl 3 0
afl-3.0: academic free license(?: version| v)? ?3 0
afl-2.1: academic free license(?: version| v)? ?2 1
bsl-1.0: boost software license(?: version)? 1 0
bsl-1.0: distributed under the boost software license
busl-1.1: business source license 1 1
ofl-1.1: sil open font license(?: version)? 1 1
ofl-1.1: open font license(?: version)? 1 1
cecill-2.1: cecill(?: version| v)? ?2 1
cecill-b: cecill b
cecill-c: cecill c
odbl-1.0: open database license(?: odbl)?(?: version| v)? ?1 0
odbl-1.0: odbl 1 0
odc-by-1.0: open data commons attribution license(?: version| v)? ?1 0
pddl-1.0: open data commons public domain dedication and license
pddl-1.0: pddl 1 0
cdla-permissive-2.0: community data license agreement permissive version 2 0
cdla-sharing-1.0: community data license agreement sharing version 1 0
zpl-2.1: zope public license(?: zpl)?(?: version)? 2 1
lppl-1.3: latex project public license(?: version)? 1 3c?
lppl-1.3: lppl 1 3c?
php-3.01: php license(?: version)? 3 01
python-2.0: python software foundation license(?: version)? 2
python-2.0: psf 2 0
ogl-uk-3.0: open government licen[cs]e v(?:ersion)? ?3(?: 0)?
ogl-uk-3.0: contains public sector information licensed under the open government licen[cs]e
etalab-2.0: licence ouverte(?: open licence)?(?: version| v)? ?2 0
cc0-1.0: cc0 1 0(?: universal)?
cc0-1.0: creative commons zero v1 0 universal
cc0-1.0: creativecommons org publicdomain zero 1 0
cc-by-2.0: cc by 2 0
cc-by-2.5: cc by 2 5
cc-by-3.0: cc by 3 0
cc-by-4.0: cc by 4 0
cc-by-3.0: creative commons attribution 3 0
cc-by-4.0: creative commons attribution 4 0(?: international)?
cc-by-4.0: creativecommons org licenses by 4 0
cc-by-3.0: creativecommons org licenses by 3 0
cc-by-sa-2.0: cc by sa 2 0
cc-by-sa-2.5: cc by sa 2 5
cc-by-sa-3.0: cc by sa 3 0
cc-by-sa-4.0: cc by sa 4 0
cc-by-sa-3.0: creative commons attribution share ?alike 3 0
cc-by-sa-4.0: creative commons attribution share ?alike 4 0(?: international)?
cc-by-sa-4.0: creativecommons org licenses by sa 4 0
cc-by-sa-3.0: creativecommons org licenses by sa 3 0
cc-by-nc-2.0: cc by nc 2 0
cc-by-nc-3.0: cc by nc 3 0
cc-by-nc-4.0: cc by nc 4 0
cc-by-nc-4.0: creative commons attribution non ?commercial 4 0(?: international)?
cc-by-nc-4.0: creativecommons org licenses by nc 4 0
cc-by-nd-3.0: cc by nd 3 0
cc-by-nd-4.0: cc by nd 4 0
cc-by-nd-4.0: creative commons attribution no ?deriv(?:ative)?s? 4 0(?: international)?
cc-by-nd-4.0: creativecommons org licenses by nd 4 0
cc-by-nc-sa-3.0: cc by nc sa 3 0
cc-by-nc-sa-4.0: cc by nc sa 4 0
cc-by-nc-sa-4.0: creative commons attribution non ?commercial share ?alike 4 0(?: international)?
cc-by-nc-sa-4.0: creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-3.0: cc by nc nd 3 0
cc-by-nc-nd-4.0: cc by nc nd 4 0
cc-by-nc-nd-4.0: creative commons attribution non ?commercial no ?deriv(?:ative)?s? 4 0(?: international)?
cc-by-nc-nd-4.0: creativecommons org licenses by nc nd 4 0
openrail-m: bigscience open rail m(?: license)?
openrail-m: creativeml open rail m
"""

FAMILY_RULES = r"""
gpl: gnu general public licen[cs]e
gpl: general public licen[cs]e
gpl: gnu gpl
gpl: gpl
lgpl: gnu lesser general public licen[cs]e
lgpl: gnu library general public licen[cs]e
lgpl: lesser general public licen[cs]e
lgpl: lgpl
agpl: gnu affero general public licen[cs]e
agpl: affero general public licen[cs]e
agpl: agpl
gfdl: gnu free documentation licen[cs]e
gfdl: gfdl
apache: apache(?: software)? licen[cs]e
apache: apache style licen[cs]e
mit: mit licen[cs]e
mit: mit style licen[cs]e
mit: expat licen[cs]e
mit: licensed under(?: the)? mit
mit: licenced under(?: the)? mit
mit: released under(?: the)? mit
bsd: bsd(?: style)? licen[cs]e
bsd: licensed under(?: the)? bsd
bsd: redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd: redistributions in binary form must reproduce the above copyright notice
bsd: redistribution and use in source and binary forms with or without modification are permitted
isc: isc licen[cs]e
zlib: zlib(?: libpng)? licen[cs]e
mpl: mozilla public licen[cs]e
mpl: mpl
epl: eclipse public licen[cs]e
cddl: common development and distribution licen[cs]e
cddl: cddl
cpl: common public licen[cs]e
ipl: ibm public licen[cs]e
eupl: european union public licen[cs]e
eupl: eupl
artistic: artistic licen[cs]e
perl: same terms as perl itself
osl: open software licen[cs]e
afl: academic free licen[cs]e
boost: boost software licen[cs]e
busl: business source licen[cs]e
sspl: server side public licen[cs]e
elastic: elastic licen[cs]e
polyform: polyform(?: noncommercial| small business| shield)? licen[cs]e
ofl: sil open font licen[cs]e
ofl: open font licen[cs]e
cecill: cecill
odbl: open database licen[cs]e
odbl: odbl
odc: open data commons
cdla: community data license agreement
zpl: zope public licen[cs]e
lppl: latex project public licen[cs]e
openssl: openssl licen[cs]e
php: php licen[cs]e
python: python software foundation licen[cs]e
ruby: ruby licen[cs]e
vim: vim licen[cs]e
curl: curl licen[cs]e
w3c: w3c software(?: notice and)? licen[cs]e
unicode: unicode licen[cs]e agreement
ncsa: university of illinois ncsa open source licen[cs]e
postgresql: postgresql licen[cs]e
unlicense: this is free and unencumbered software released into the public domain
unlicense: unlicense
wtfpl: wtfpl
wtfpl: do what the fuck you want to public license
beerware: beer ware licen[cs]e
beerware: beerware
ms-pl: microsoft public licen[cs]e
ms-rl: microsoft reciprocal licen[cs]e
ms-eula: microsoft software license terms
apsl: apple public source licen[cs]e
nasa: nasa open source agreement
ogl: open government licen[cs]e
etalab: licence ouverte
game: open gaming licen[cs]e
cc: creative commons(?: public)? licen[cs]e
cc: creativecommons org licenses
cc0: creative commons zero
cc0: cc0
cc-by: creative commons attribution
cc-by: cc by
cc-by-sa: cc by sa
cc-by-sa: creative commons attribution share ?alike
cc-by-nc: cc by nc
cc-by-nc: creative commons attribution non ?commercial
cc-by-nd: cc by nd
cc-by-nd: creative commons attribution no ?deriv(?:ative)?s?
cc-by-nc-sa: cc by nc sa
cc-by-nc-sa: creative commons attribution non ?commercial share ?alike
cc-by-nc-nd: cc by nc nd
cc-by-nc-nd: creative commons attribution non ?commercial no ?deriv(?:ative)?s?
public-domain: dedicated to the public domain
public-domain: released into the public domain
public-domain: placed in the public domain
public-domain: public domain
openrail: open rail
llama: llama(?: 2| 3)? community license
"""

NOTICE_RULES = r"""
reserved: all rights reserved
reserved: some rights reserved
copyright: copyright(?: c)? (?:19|20)[0-9]{2}
copyright: copyrighted material
copyright: protected by copyright
licensed: licensed under(?: the terms of)?
licensed: licenced under(?: the terms of)?
licensed: released under(?: the terms of)?
licensed: distributed under the terms of
licensed: available under the terms of
licensed: dual licensed
licensed: spdx license identifier
permission: permission is hereby granted
permission: permission is granted to copy
permission: used with permission
permission: reproduced with permission
permission: reprinted with permission
forbidden: reproduction in whole or in part(?: without(?: prior)?(?: written)? permission)? is(?: strictly)? prohibited
forbidden: no part of this (?:book|publication|document|work) may be reproduced
forbidden: may not be published broadcast rewritten or redistributed
forbidden: unauthorized (?:use|copying|reproduction|distribution)
forbidden: not for redistribution
forbidden: for personal use only
forbidden: noncommercial use only
forbidden: non commercial use only
confidential: proprietary and confidential
confidential: confidential and proprietary
confidential: trade secrets? of
warranty: without warranty of any kind
warranty: without any warranty
warranty: provided as is
warranty: provided by the copyright holders and contributors as is
warranty: implied warranties of merchantability
warranty: in no event shall the (?:authors?|copyright holders?)
trademark: registered trademarks? of
trademark: trademark of
trademark: trademarks of
patent: patent pending
terms: terms of (?:use|service)
terms: end user licen[cs]e agreement
terms: subject to the following conditions
attribution: attribution required
attribution: courtesy of
"""


#: The first one or two words of an expression that stand there as they are.
KEYWORD = re.compile(r"[a-z0-9]+(?= [^?]|$|\(\?: )(?: [a-z0-9]+(?= [^?]|$|\(\?: ))?")


def rules() -> list[tuple[str, str, str, int]]:
    """(label, keyword, expression, priority) of every rule, in order."""
    found = []
    for table, priority in ((EXACT_RULES, EXACT), (FAMILY_RULES, FAMILY), (NOTICE_RULES, NOTICE)):
        for line in table.strip().splitlines():
            label, expression = line.split(": ", 1)
            found.append((label, KEYWORD.match(expression)[0], expression, priority))
    return found
