"""License signatures: names of licences and clauses of their texts, as patterns over normalised words.

A text is normalised to its lower-case words with one space around each: "GPL-3.0" is " gpl 3 0 ".
``rules`` builds the ordered rule table: three forms of each name (tag, notice, name) and the clauses.
"""

import re
from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    kind: str
    priority: int
    weight: float
    gates: tuple  # phrases of which a match contains one
    pattern: re.Pattern


#: (priority, weight) of the kinds of rules
KINDS = {"clause": (90, 1.0), "tag": (80, 1.0), "notice": (70, 0.9), "name": (50, 0.6), "hint": (20, 0.3)}

#: label | phrases, one of which every match contains | pattern of the licence's name
NAMES = r"""
mit | mit license, mit licence, mit x11, mit expat, expat license | (?:mit(?: x11| expat)? licen[cs]e|mit x11|mit expat|expat license)
mit-0 | mit 0, mit no attribution | (?:mit 0|mit no attribution(?: license)?)
x11 | x11 license | x11 license
isc | isc license, isc licence | isc licen[cs]e
bsd | bsd license, bsd licence, bsd style | bsd(?: style)?(?: licen[cs]e)?
bsd-2-clause | bsd 2 clause, 2 clause bsd, simplified bsd, freebsd license | (?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: license)?
bsd-3-clause | bsd 3 clause, 3 clause bsd, new bsd, modified bsd, revised bsd | (?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: license)?
bsd-4-clause | bsd 4 clause, 4 clause bsd, original bsd | (?:bsd 4 clause|4 clause bsd|original bsd)(?: license)?
0bsd | 0bsd, zero clause bsd, bsd zero clause | (?:0bsd|zero clause bsd|bsd zero clause)(?: license)?
apache-1 | apache license version 1, apache software license version 1, apache 1 | apache(?: software)?(?: license)?(?: version)? 1(?: [01])?
apache-2 | apache license version 2, apache license 2, apache license v2, apache 2, apache software license version 2 | apache(?: software)?(?: license)?(?: version)? (?:2|v2)(?: 0)?
apache | apache license, apache licence, apache software license | apache(?: software)? licen[cs]e
gpl-1 | general public license version 1, gplv1, gpl 1 | (?:gnu )?(?:general public license(?: version)?|gpl(?: version)?) 1(?: 0)?|gplv1
gpl-2 | general public license version 2, general public license v2, gplv2, gpl 2, gpl v2, gpl version 2 | (?:gnu )?(?:general public license(?: version)? (?:2|v2)(?: 0)?|gpl(?: version)? (?:2|v2)(?: 0)?|gplv2)(?: only| or later| or any later version)?
gpl-3 | general public license version 3, general public license v3, gplv3, gpl 3, gpl v3, gpl version 3 | (?:gnu )?(?:general public license(?: version)? (?:3|v3)(?: 0)?|gpl(?: version)? (?:3|v3)(?: 0)?|gplv3)(?: only| or later| or any later version)?
gpl | gnu general public license, general public license, gnu gpl, gpl license, gpl licence, the gpl | (?:gnu general public licen[cs]e|(?<!mozilla )(?<!affero )(?<!lesser )general public license|gnu gpl|(?:the )?gpl(?: licen[cs]e)?)
lgpl-2 | library general public license, lgplv2, lgpl 2 0, lgpl v2 | (?:gnu )?(?:library general public license(?: version 2)?|lgpl(?: version)? (?:2 0|v2)|lgplv2)(?: only| or later)?
lgpl-2.1 | lesser general public license version 2 1, lesser general public license v2 1, lgplv2 1, lgpl 2 1, lgpl v2 1 | (?:gnu )?(?:lesser general public license(?: version)? (?:2|v2) 1|lgpl(?: version)? (?:2|v2) 1|lgplv2 1)(?: only| or later)?
lgpl-3 | lesser general public license version 3, lesser general public license v3, lgplv3, lgpl 3, lgpl v3 | (?:gnu )?(?:lesser general public license(?: version)? (?:3|v3)(?: 0)?|lgpl(?: version)? (?:3|v3)(?: 0)?|lgplv3)(?: only| or later)?
lgpl | lesser general public license, gnu lgpl, the lgpl | (?:gnu lesser general public license|lesser general public license|gnu lgpl|the lgpl)
agpl-3 | affero general public license version 3, affero general public license v3, agplv3, agpl 3, agpl v3 | (?:gnu )?(?:affero general public license(?: version)? (?:3|v3)(?: 0)?|agpl(?: version)? (?:3|v3)(?: 0)?|agplv3)(?: only| or later)?
agpl | affero general public license, gnu agpl, the agpl | (?:gnu )?(?:affero general public license|gnu agpl|the agpl)
gfdl | free documentation license, gnu fdl, gfdl | (?:gnu )?(?:free documentation license|gnu fdl|gfdl)(?:(?: version)? 1(?: [123])?)?
mpl-1.1 | mozilla public license version 1, mozilla public license 1, mpl 1 | (?:mozilla public license(?: version)?|mpl) 1(?: [01])?
mpl-2 | mozilla public license version 2, mozilla public license 2, mozilla public license v 2, mpl 2, mplv2 | (?:(?:mozilla public license(?: version| v)?|mpl) 2(?: 0)?|mplv2)
mpl | mozilla public license | mozilla public license
epl-1 | eclipse public license version 1, eclipse public license v1, eclipse public license 1, epl 1 | (?:eclipse public license(?: version| v)?|epl) (?:1|v1)(?: 0)?
epl-2 | eclipse public license version 2, eclipse public license v2, eclipse public license 2, epl 2 | (?:eclipse public license(?: version| v)?|epl) (?:2|v2)(?: 0)?
epl | eclipse public license | eclipse public license
edl | eclipse distribution license | eclipse distribution license(?: v 1 0| version 1 0)?
cddl | common development and distribution license, cddl 1 | (?:common development and distribution license(?: cddl)?(?: version)?(?: 1 [01])?|cddl 1(?: [01])?)
cpl | common public license | common public license(?: version)?(?: 1 0)?
ibm-pl | ibm public license | ibm public license(?: version)?(?: 1 0)?
eupl | european union public licence, european union public license, eupl 1 | (?:european union public licen[cs]e(?: v| version)?(?: 1 [012])?|eupl 1(?: [012])?)
cecill | cecill | cecill(?: b| c)?(?: 2 [01])?(?: license)?
artistic-1 | artistic license 1, artistic license version 1, artistic 1 | artistic(?: license)?(?: version)? 1(?: 0)?
artistic-2 | artistic license 2, artistic license version 2, artistic 2 | artistic(?: license)?(?: version)? 2(?: 0)?
artistic | artistic license | artistic license
psf | python software foundation license, psf license, python license | (?:python software foundation license|psf license|python license)(?: version)?(?: 2)?
ruby | ruby license | ruby license
php | php license | php license(?: version)?(?: 3(?: 0 1)?)?
perl | same terms as perl | same terms as perl(?: itself)?
zlib | zlib license, zlib libpng license | zlib(?: libpng)? license
libpng | libpng license | libpng license
bsl-1 | boost software license, bsl 1 0 | (?:boost software license(?: version)?(?: 1 0)?|bsl 1 0)
busl | business source license, busl 1 1 | (?:business source license(?: version)?(?: 1 1)?|busl 1 1)
sspl | server side public license, sspl 1 | (?:server side public license(?: version)?(?: 1)?|sspl 1)
elastic | elastic license | elastic license(?: version)?(?: 2(?: 0)?)?
commons-clause | commons clause | commons clause(?: license)?(?: condition)?
polyform | polyform | polyform (?:noncommercial|small business|shield|perimeter|strict)(?: license)?(?: 1 0 0)?
unlicense | the unlicense, unlicense license | (?:the unlicense|unlicense license)
wtfpl | wtfpl | wtfpl(?: v2| version 2)?
beerware | beerware, beer ware license | (?:beerware|beer ware)(?: license)?
cc0 | cc0, creative commons zero | (?:cc0(?: 1 0)?(?: universal)?|creative commons zero(?: v1 0)?(?: universal)?)
cc-by | cc by, creative commons attribution | (?:cc by|creative commons attribution)(?: license)?(?: [1234] [05])?(?: international| unported| generic)?(?: license)?
cc-by-sa | cc by sa, attribution sharealike, attribution share alike | (?:cc by sa|creative commons attribution share ?alike)(?: [1234] [05])?(?: international| unported| generic)?(?: license)?
cc-by-nd | cc by nd, attribution noderivatives, attribution noderivs | (?:cc by nd|creative commons attribution noderiv(?:ative)?s)(?: [1234] [05])?(?: international| unported| generic)?(?: license)?
cc-by-nc | cc by nc, attribution noncommercial, attribution non commercial | (?:cc by nc|creative commons attribution non ?commercial)(?: [1234] [05])?(?: international| unported| generic)?(?: license)?
cc-by-nc-sa | cc by nc sa, noncommercial sharealike, noncommercial share alike, non commercial share alike | (?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1234] [05])?(?: international| unported| generic)?(?: license)?
cc-by-nc-nd | cc by nc nd, noncommercial noderivatives, noncommercial noderivs, non commercial no derivatives | (?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s)(?: [1234] [05])?(?: international| unported| generic)?(?: license)?
creative-commons | creative commons license, creative commons licence | creative commons licen[cs]e
odbl | open database license, odbl | (?:open database license(?: odbl)?|odbl)(?: v?1 0)?
odc-by | open data commons attribution, odc by | (?:open data commons attribution license|odc by)(?: v?1 0)?
pddl | public domain dedication and license, pddl | (?:(?:open data commons )?public domain dedication and license|pddl)(?: v?1 0)?
cdla-permissive | cdla permissive, community data license agreement permissive | (?:cdla|community data license agreement) permissive(?: version)?(?: [12] 0)?
cdla-sharing | cdla sharing, community data license agreement sharing | (?:cdla|community data license agreement) sharing(?: version)?(?: 1 0)?
ogl | open government licence, open government license | open government licen[cs]e(?: v| version)?(?: ?[123] 0)?
etalab | etalab, licence ouverte | (?:etalab(?: 2 0)?|licence ouverte)(?: open licence)?
dl-de | datenlizenz deutschland | datenlizenz deutschland(?: namensnennung| zero)?(?: 2 0)?
ofl-1.1 | open font license, ofl 1 1 | (?:(?:sil )?open font license(?: version)?(?: 1 1)?|ofl 1 1)
openrail | openrail, open rail | (?:bigscience |creativeml |bigcode )?open ?rail(?: m| s| d)?(?: v1)?(?: license)?
llama | llama community license, llama 2 community, llama 3 community | llama(?: \d){0,2} community license(?: agreement)?
gemma | gemma terms of use | gemma terms of use
ms-pl | microsoft public license, ms pl | microsoft public license(?: ms pl)?|ms pl
ms-rl | microsoft reciprocal license, ms rl | microsoft reciprocal license(?: ms rl)?|ms rl
apsl | apple public source license | apple public source license(?: version)?(?: [12] [012])?
osl-3 | open software license, osl 3 | open software license(?: v| version)?(?: ?3 0)?|osl 3 0
afl-3 | academic free license, afl 3 | academic free license(?: v| version)?(?: ?[123] [01])?|afl 3 0
ecl-2 | educational community license | educational community license(?: version)?(?: 2 0)?
ncsa | university of illinois ncsa, ncsa open source license | (?:university of illinois )?ncsa(?: open source)? license
postgresql | postgresql license | postgresql license
openssl | openssl license | openssl license
sleepycat | sleepycat license | sleepycat license
qpl | q public license | q public license(?: version)?(?: 1 0)?
lppl | latex project public license, lppl | latex project public license|lppl(?: version)?(?: 1 3c?)?
vim | vim license | vim license
w3c | w3c software notice, w3c software license | w3c software (?:notice and )?license
unicode | unicode license, unicode terms of use | unicode (?:license(?: agreement)?|terms of use)
upl | universal permissive license | universal permissive license(?: v| version)?(?: ?1 0)?
blueoak | blue oak model license | blue oak model license(?: 1 0 0)?
mulan | mulan psl, mulan permissive | mulan (?:psl|permissive software license)(?: v?[12])?
hippocratic | hippocratic license | hippocratic license(?: [123] [01])?
json | json license | json license
cern-ohl | cern open hardware licence, cern ohl | cern (?:open hardware licence|ohl)(?: version)?(?: 2)?(?: [psw])?
solderpad | solderpad | solderpad(?: hardware)? licen[cs]e
gust | gust font license | gust font license
intel | intel open source license | intel open source license
nasa | nasa open source agreement | nasa open source agreement(?: version)?(?: 1 3)?
nposl | non profit open software license | non profit open software license
watcom | sybase open watcom public license | sybase open watcom public license
"""

#: label | phrase that every match contains | pattern of a clause
CLAUSES = r"""
mit | permission is hereby granted free of charge to any person obtaining | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation(?: files)?
mit | the above copyright notice and this permission notice shall be included | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
isc | permission to use copy modify and | permission to use copy modify and (?:or )?distribute this software (?:\S+ ){0,4}?for any purpose with or without fee is hereby granted
0bsd | for any purpose with or without fee is hereby granted the software | for any purpose with or without fee is hereby granted the software is provided as is
bsd | redistribution and use in source and binary forms | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | to endorse or promote products derived from this software | neither the name of (?:\S+ ){1,16}?may be used to endorse or promote products derived from this software
bsd-4-clause | all advertising materials mentioning features | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
zlib | altered source versions must be plainly marked | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
bsl-1 | person or organization obtaining a copy of the software and accompanying | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
unlicense | free and unencumbered software | this is free and unencumbered software released into the public domain
apache-2 | you may not use this file except in compliance with the license | (?:licensed under the apache license version 2 0 the license )?you may not use this file except in compliance with the license
apache-2 | each contributor hereby grants to you a perpetual worldwide | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) license|each contributor hereby grants to you a perpetual worldwide
gpl-2 | as published by the free software foundation | under the terms of the gnu general public license as published by the free software foundation(?: either)? version 2(?: of the license)?(?: or (?:at your option )?any later version)?
gpl-3 | as published by the free software foundation | under the terms of the gnu general public license as published by the free software foundation(?: either)? version 3(?: of the license)?(?: or (?:at your option )?any later version)?
lgpl-2.1 | as published by the free software foundation | under the terms of the gnu lesser general public license as published by the free software foundation(?: either)? version 2 1(?: of the license)?(?: or (?:at your option )?any later version)?
lgpl-3 | as published by the free software foundation | under the terms of the gnu lesser general public license as published by the free software foundation(?: either)? version 3(?: of the license)?(?: or (?:at your option )?any later version)?
agpl-3 | as published by the free software foundation | under the terms of the gnu affero general public license as published by the free software foundation(?: either)? version 3(?: of the license)?(?: or (?:at your option )?any later version)?
gpl-2 | designed to take away your freedom | the licenses for most software are designed to take away your freedom to share and change it
gpl-3 | free copyleft license for software and other kinds of works | the gnu general public license is a free copyleft license for software and other kinds of works
agpl-3 | cooperation with the community in the case of network server software | (?:\S+ ){0,20}?specifically designed to ensure cooperation with the community in the case of network server software
lgpl | incorporates the terms and conditions of version 3 of the gnu general public license | this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license
gfdl | permission is granted to copy distribute and | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
mpl-2 | this source code form is subject to the terms of the mozilla public license | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | contents of this file are subject to the mozilla public license | the contents of this file are subject to the mozilla public license version 1 [01]
epl-2 | this program and the accompanying materials are made available under the terms of the eclipse public license | this program and the accompanying materials are made available under the terms of the eclipse public license 2 0
epl-1 | this program and the accompanying materials are made available under the terms of the eclipse public license | this program and the accompanying materials are made available under the terms of the eclipse public license v1 0
cddl | subject to the terms of the common development and distribution license | the contents of this file are subject to the terms of the common development and distribution license
ofl-1.1 | this font software is licensed under the sil open font license | this font software is licensed under the sil open font license version 1 1
cc0 | has waived all copyright and related or neighboring rights | to the extent possible under law (?:\S+ ){0,20}?has waived all copyright and related or neighboring rights
cc0 | has dedicated the work to the public domain | the person who associated a work with this deed has dedicated the work to the public domain
cc-by | you must give appropriate credit | you must give appropriate credit provide a link to the license and indicate if changes were made
cc-by-nc | you may not use the material for commercial purposes | you may not use the material for commercial purposes
cc-by-sa | you must distribute your contributions under the same license | if you remix transform or build upon the material you must distribute your contributions under the same license as the original
cc-by-nd | you may not distribute the modified material | if you remix transform or build upon the material you may not distribute the modified material
odbl | this database is made available under the open database license | this (?:\S+ )?database is made available under the open database license
ogl | contains public sector information licensed under | contains public sector information licensed under the open government licence(?: v[123] 0)?
wtfpl | everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed | everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed
gpl | everyone is permitted to copy and distribute verbatim copies of this license document | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
beerware | as long as you retain this notice you can do whatever you want | as long as you retain this notice you can do whatever you want with this stuff
json | the software shall be used for good not evil | the software shall be used for good not evil
artistic | the intent of this document is to state the conditions under which a package may be copied | the intent of this document is to state the conditions under which a package may be copied
psf | psf hereby grants licensee a nonexclusive royalty free | psf hereby grants licensee a nonexclusive royalty free world ?wide license
openssl | developed by the openssl project for use in the openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
postgresql | without a written agreement is hereby granted | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
eupl | provided under the terms of this licence | the work is provided under the terms of this licence
sspl | making the functionality of the program available to third parties as a service | making the functionality of the program available to third parties as a service
commons-clause | does not grant to you the right to sell the software | (?:the license )?does not grant to you the right to sell the software
ms-pl | if you use the software you accept this license | this license governs use of the accompanying software if you use the software you accept this license
proprietary | proprietary and confidential | (?:this \S+ is )?proprietary and confidential
proprietary | unauthorized copying of this file | unauthorized copying of this file via any medium is strictly prohibited
proprietary | prior written permission | (?:may not be|no part of this (?:\S+ ){1,3}?may be) (?:\S+ ){1,12}?without (?:the )?(?:express )?prior written permission
proprietary | prior written consent | (?:may not be|no part of this (?:\S+ ){1,3}?may be) (?:\S+ ){1,12}?without (?:the )?(?:express )?prior written consent
proprietary | not for redistribution | not for redistribution
proprietary | end user license agreement | end user license agreement
"""

#: label | phrase | pattern: weak hints
HINTS = r"""
all-rights-reserved | all rights reserved | (?:copyright (?:\S+ ){0,8}?)?all rights reserved
public-domain | public domain | (?:released (?:in)?to|dedicated to|placed in|in) the public domain
open-source | open source license | (?:an )?open source license
proprietary | proprietary license | proprietary license
copyright | copyright notice | copyright notice
"""

#: labels and phrases that are always looked for
BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
TAG = "spdx license identifier"


def _rows(table):
    for line in table.strip().splitlines():
        label, gates, pattern = (part.strip() for part in line.split(" | ", 2))
        yield label, tuple(g.strip() for g in gates.split(",")), pattern


def _rule(label, kind, gates, pattern):
    return Rule(label, kind, *KINDS[kind], gates, re.compile(f"(?<= )(?:{pattern})(?= )".replace(r"\S", "[^ ]")))


def rules() -> list:
    """All rules, those of higher priority first, in the order of the tables."""
    out = []
    for label, gates, name in _rows(NAMES):
        named = f"{name}|{re.sub('[-.]', ' ', label)}"
        out.append(_rule(label, "tag", (TAG,), rf"{TAG} (?:(?:\S+ ){{0,12}}?(?:or|and) )?({named})"))  # the detection is the group
        out.append(_rule(label, "notice", gates, rf"(?:(?:licen[cs]ed|released|distributed|available|provided|published|covered) )?under (?:(?!under )\S+ ){{0,6}}?(?:{name})"))
        out.append(_rule(label, "name", gates, name))
    for kind, table in (("clause", CLAUSES), ("hint", HINTS)):
        out += [_rule(label, kind, gates, pattern) for label, gates, pattern in _rows(table)]
    return sorted(out, key=lambda r: -r.priority)
