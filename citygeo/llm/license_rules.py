"""Signature rules for licenses, written by hand: ``label | priority | keyword | expression``.

Expressions run over lowered words joined by single spaces, and match whole words. V stands for an optional version such as
"version 2 0", "v2 0" or "2 0". Priorities: 95 a title with version, 90 a title, 85 an identifier after a tag, 80 a phrase of
the license's own text, 60 a notice, 40 a hint.
"""

from __future__ import annotations

_TEXT = r"""
gpl-3.0 | 95 | general public | gnu general public license V3
gpl-2.0 | 95 | general public | gnu general public license V2
gpl-1.0 | 95 | general public | gnu general public license V1
gpl | 90 | general public | (?:gnu )?general public license
gpl-3.0 | 85 | gpl | gpl ?v?3(?: 0)?(?: only| or later)?
gpl-2.0 | 85 | gpl | gpl ?v?2(?: 0)?(?: only| or later)?
gpl | 60 | gpl | (?:licensed|released|distributed) under (?:the )?(?:terms of )?(?:the )?gpl
gpl | 80 | free software foundation | under the terms of the gnu general public license as published by the free software foundation
gpl | 80 | without even the implied warranty | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license
gpl-classpath | 95 | classpath | classpath exception(?: 2 0)?
gpl-linking-exception | 90 | linking exception | (?:gpl )?linking exception
gcc-exception | 95 | gcc runtime | gcc runtime library exception(?: V3)?(?: 1)?
bison-exception | 90 | bison | bison exception(?: 2 2)?
font-exception | 90 | font exception | (?:gpl )?font exception
lgpl-3.0 | 95 | lesser general | gnu lesser general public license V3
lgpl-2.1 | 95 | lesser general | gnu lesser general public license V2 1
lgpl-2.0 | 95 | library general | gnu library general public license(?: V2)?
lgpl | 92 | lesser general | (?:gnu )?lesser general public license
lgpl | 85 | lgpl | lgpl(?: ?v?[23](?: [01])?)?(?: only| or later)?
agpl-3.0 | 95 | affero | gnu affero general public license V3
agpl | 92 | affero | (?:gnu )?affero general public license
agpl-1.0 | 95 | affero | affero general public license V1
agpl | 85 | agpl | agpl(?: ?v?[13](?: 0)?)?(?: only| or later)?
gfdl-1.3 | 95 | free documentation | gnu free documentation license V1 3
gfdl-1.2 | 95 | free documentation | gnu free documentation license V1 2
gfdl-1.1 | 95 | free documentation | gnu free documentation license V1 1
gfdl | 90 | free documentation | (?:gnu )?free documentation license
gfdl | 85 | gfdl | gfdl(?: 1 [123])?
gfdl | 80 | invariant sections | with no invariant sections no front cover texts and no back cover texts
gnu-all-permissive | 80 | copying and distribution of this file | copying and distribution of this file with or without modification are permitted in any medium without royalty
apache-2.0 | 95 | apache | apache (?:software )?license V2
apache-1.1 | 95 | apache | apache (?:software )?license V1 1
apache-1.0 | 95 | apache | apache (?:software )?license V1 0
apache | 90 | apache | apache (?:software )?license
apache-2.0 | 85 | apache | apache ?2(?: 0)?
apache-1.1 | 85 | apache | apache 1 1
apache-2.0 | 80 | apache org licenses | www apache org licenses license 2 0
apache-2.0 | 80 | on an as is basis | distributed on an as is basis without warranties or conditions of any kind
apache | 60 | apache | (?:licensed|released|distributed) under (?:the )?apache
llvm-exception | 95 | llvm | (?:apache 2 0 with )?llvm exceptions?
mit | 90 | mit | mit license
mit | 88 | expat | expat license
mit | 85 | mit | (?:spdx license identifier|license|licence) mit
mit | 60 | mit | (?:licensed|released|distributed) under (?:the )?(?:terms of )?(?:the )?mit
mit | 80 | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 70 | the above copyright notice and this permission | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0 | 95 | mit | mit (?:0|no attribution)(?: license)?
mit-advertising | 95 | mit | mit (?:license )?with advertising
mit-modern | 95 | modern variant | mit (?:license )?modern variant
mit-feh | 90 | feh | feh license
x11 | 90 | x11 | x11 license
x11 | 85 | x consortium | x consortium license
hpnd | 90 | historical permission | historical permission notice and disclaimer
isc | 90 | isc | isc license
isc | 85 | isc | (?:spdx license identifier|license|licence) isc
isc | 80 | permission to use copy modify | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
0bsd | 95 | 0bsd | (?:bsd zero clause license|0bsd)
0bsd | 95 | zero clause | (?:bsd )?zero clause(?: bsd)?(?: license)?
bsd-1-clause | 95 | 1 clause | bsd 1 clause(?: license)?
bsd-2-clause | 95 | 2 clause | (?:bsd 2 clause|2 clause bsd)(?: license)?
bsd-2-clause | 90 | simplified bsd | simplified bsd license
bsd-2-clause | 90 | freebsd | freebsd license
bsd-2-clause-patent | 97 | patent | bsd 2 clause (?:plus )?patent(?: license)?
bsd-3-clause | 95 | 3 clause | (?:bsd 3 clause|3 clause bsd)(?: license)?
bsd-3-clause | 90 | new bsd | (?:the )?new bsd license
bsd-3-clause | 90 | modified bsd | (?:the )?modified bsd license
bsd-3-clause | 90 | revised bsd | (?:the )?revised bsd license
bsd-3-clause-clear | 97 | clear | bsd 3 clause clear(?: license)?
bsd-3-clause-lbnl | 97 | lbnl | (?:bsd 3 clause )?lbnl(?: bsd)?(?: license)?
bsd-4-clause | 95 | 4 clause | (?:bsd 4 clause|4 clause bsd)(?: license)?
bsd-4-clause | 90 | original bsd | original bsd license
bsd-4-clause | 80 | all advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-source-code | 90 | bsd source code | bsd source code attribution
bsd-protection | 90 | bsd protection | bsd protection license
bsd | 88 | bsd | bsd (?:style )?licen[cs]e
bsd | 60 | bsd | (?:licensed|released|distributed) under (?:the )?bsd
bsd | 80 | redistribution and use in source | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | 82 | to endorse or promote | may be used to endorse or promote products derived from this software without specific prior written permission
mpl-2.0 | 95 | mozilla | mozilla public license V2
mpl-1.1 | 95 | mozilla | mozilla public license V1 1
mpl-1.0 | 95 | mozilla | mozilla public license V1 0
mpl | 90 | mozilla public | mozilla public license
mpl | 85 | mpl | mpl ?v?[12](?: [01])?
mpl-2.0 | 80 | source code form is subject | this source code form is subject to the terms of the mozilla public license
npl | 90 | netscape | netscape public license(?: V1)?(?: [01])?
epl-2.0 | 95 | eclipse | eclipse public license V2
epl-1.0 | 95 | eclipse | eclipse public license V1
epl | 90 | eclipse public | eclipse public license
epl | 85 | epl | epl ?v?[12] 0
edl | 90 | eclipse distribution | eclipse distribution license(?: V1)?
cpl-1.0 | 90 | common public | common public license(?: V1)?
ipl-1.0 | 90 | ibm public | ibm public license(?: V1)?
cddl-1.1 | 95 | distribution license | common development and distribution license V1 1
cddl-1.0 | 92 | distribution license | common development and distribution license(?: V1)?
cddl | 85 | cddl | cddl(?: ?v?1 [01])?
cpal-1.0 | 90 | attribution license | common public attribution license(?: V1)?
osl-3.0 | 95 | open software license | open software license V3
osl | 90 | open software license | open software license
afl-3.0 | 95 | academic free | academic free license V3
afl | 90 | academic free | academic free license
artistic-2.0 | 95 | artistic | artistic license V2
artistic-1.0 | 95 | artistic | artistic license V1
artistic | 90 | artistic license | artistic license
perl | 60 | same terms as perl | under the same terms as perl itself
eupl-1.2 | 95 | european union public | european union public licen[cs]e V1 2
eupl-1.1 | 95 | european union public | european union public licen[cs]e V1 1
eupl | 90 | european union public | european union public licen[cs]e
eupl | 85 | eupl | eupl(?: ?v?1 [012])?
cecill-2.1 | 95 | cecill | cecill(?: license)? V2 1
cecill-b | 95 | cecill | cecill b(?: license)?
cecill-c | 95 | cecill | cecill c(?: license)?
cecill | 88 | cecill | cecill(?: free software license(?: agreement)?| license)?
bsl-1.0 | 90 | boost | boost software license(?: V1)?
bsl-1.0 | 80 | boost org | www boost org license 1 0 txt
busl-1.1 | 90 | business source | business source license(?: V1)?(?: 1)?
sspl-1.0 | 90 | server side public | server side public license(?: V1)?
elastic-2.0 | 90 | elastic license | elastic license(?: V2)?
commons-clause | 90 | commons clause | commons clause(?: license condition)?
polyform-noncommercial | 90 | polyform | polyform noncommercial(?: license)?(?: V1)?
polyform-small-business | 90 | polyform | polyform small business(?: license)?(?: V1)?
polyform-shield | 90 | polyform | polyform shield(?: license)?(?: V1)?
unlicense | 90 | unlicense | (?:the )?unlicense
unlicense | 80 | unencumbered | free and unencumbered software released into the public domain
wtfpl | 90 | wtfpl | wtfpl
wtfpl | 90 | what the fuck | do what the fuck you want to public license
zlib | 90 | zlib | zlib license
zlib | 85 | zlib | zlib libpng license
zlib | 80 | provided as is without any express | this software is provided as is without any express or implied warranty
libpng | 90 | libpng | libpng license(?: V2)?
openssl | 90 | openssl | openssl license
ssleay | 90 | ssleay | (?:original )?ssleay license
psf-2.0 | 90 | python software | python software foundation license(?: V2)?
python-2.0 | 90 | python license | python license(?: V2)?
cnri-python | 90 | cnri | cnri (?:open source )?(?:python )?license
php-3.01 | 95 | php | php license V3 01
php-3.0 | 93 | php | php license V3
php | 90 | php license | php license
ruby | 90 | ruby license | ruby license
lua | 80 | lua | lua license
tcl | 85 | tcl | tcl tk license
postgresql | 90 | postgresql | postgresql licen[cs]e
ncsa | 90 | ncsa | (?:university of illinois )?ncsa(?: open source)? license
ncsa | 85 | illinois | university of illinois open source license
upl-1.0 | 90 | universal permissive | universal permissive license(?: V1)?
ms-pl | 90 | microsoft public | microsoft public license
ms-rl | 90 | microsoft reciprocal | microsoft reciprocal license
ms-pl | 85 | ms pl | ms pl
apsl-2.0 | 90 | apple public | apple public source license(?: V2)?
intel | 90 | intel open source | intel open source license
nokia | 90 | nokia | nokia open source license
sissl | 90 | sun industry | sun industry standards source license
spl-1.0 | 90 | sun public | sun public license(?: V1)?
qpl-1.0 | 90 | q public | q public license(?: V1)?
sleepycat | 90 | sleepycat | sleepycat license
vim | 90 | vim license | vim license
w3c | 90 | w3c | w3c (?:software )?(?:notice and )?(?:document )?license
ofl-1.1 | 90 | open font | (?:sil )?open font license(?: V1)?(?: 1)?
ofl-1.1 | 85 | ofl | ofl 1 1
bitstream-vera | 90 | bitstream vera | bitstream vera (?:fonts? )?(?:copyright|license)
ubuntu-font | 90 | ubuntu font | ubuntu font licen[cs]e(?: V1)?
lppl-1.3c | 90 | latex project | latex project public license(?: V1)?(?: 3c)?
unicode | 90 | unicode license | unicode license(?: agreement)?(?: V3)?
icu | 90 | icu license | icu license
ijg | 80 | independent jpeg | independent jpeg group
curl | 90 | curl license | curl license
json | 90 | json license | json license
json | 80 | for good not evil | software shall be used for good not evil
beerware | 90 | beer ware | beer ware license
beerware | 85 | beerware | beerware
blueoak-1.0.0 | 90 | blue oak | blue oak model license(?: V1)?(?: 0)?
ecl-2.0 | 90 | educational community | educational community license(?: V2)?
entessa | 90 | entessa | entessa public license
eiffel | 90 | eiffel | eiffel forum license(?: V[12])?
fair | 90 | fair license | fair license
frameworx | 90 | frameworx | frameworx open license
nasa-1.3 | 90 | nasa | nasa open source agreement(?: V1)?(?: 3)?
ngpl | 90 | nethack | nethack general public license
nposl-3.0 | 90 | non profit open | non profit open software license(?: V3)?
oclc-2.0 | 90 | oclc | oclc research public license(?: V2)?
ppl | 90 | peer production | peer production license
rpl-1.5 | 90 | reciprocal public | reciprocal public license(?: V1)?(?: 5)?
rpsl-1.0 | 90 | realnetworks | realnetworks public source license(?: V1)?
simpl-2.0 | 90 | simple public | simple public license(?: V2)?
tmate | 90 | tmate | tmate open source license
watcom-1.0 | 90 | watcom | sybase open watcom public license(?: V1)?
xnet | 90 | x net | x net license
zpl-2.1 | 90 | zope | zope public license(?: V[12])?(?: [01])?
zend-2.0 | 90 | zend | zend license(?: V2)?
yahoo-1.1 | 90 | yahoo | yahoo public license(?: V1)?(?: 1)?
mulan-psl-2.0 | 90 | mulan | mulan (?:psl|permissive software license)(?: V[12])?
ogl-3.0 | 90 | open government | open government licen[cs]e(?: V[123])?
odbl-1.0 | 90 | open database | open (?:data commons )?(?:open )?database licen[cs]e(?: V1)?
odbl-1.0 | 85 | odbl | odbl(?: 1 0)?
odc-by-1.0 | 90 | data commons | open data commons attribution licen[cs]e(?: V1)?
pddl-1.0 | 90 | public domain dedication | (?:open data commons )?public domain dedication and licen[cs]e
cdla-permissive | 90 | data license agreement | community data license agreement permissive(?: V[12])?
cdla-sharing | 90 | data license agreement | community data license agreement sharing(?: V1)?
dl-de-by-2.0 | 90 | datenlizenz | datenlizenz deutschland namensnennung(?: V2)?
etalab-2.0 | 90 | licence ouverte | licence ouverte(?: etalab)?(?: V[12])?
free-art-1.3 | 90 | free art | free art license(?: 1 3)?
free-art-1.3 | 90 | licence art libre | licence art libre(?: 1 3)?
open-rail | 90 | rail | (?:creativeml )?open ?rail(?: m)?(?: license)?
llama | 90 | llama | llama [234](?: [123])? community license(?: agreement)?
gemma | 90 | gemma | gemma terms of use
cc-by-nc-nd | 95 | cc by | cc by nc nd(?: [1234] [05])?
cc-by-nc-sa | 95 | cc by | cc by nc sa(?: [1234] [05])?
cc-by-nc | 93 | cc by | cc by nc(?: [1234] [05])?
cc-by-nd | 93 | cc by | cc by nd(?: [1234] [05])?
cc-by-sa | 93 | cc by | cc by sa(?: [1234] [05])?
cc-by | 90 | cc by | cc by(?: [1234] [05])?
cc0 | 95 | cc0 | cc0(?: 1 0)?(?: universal)?
cc0 | 90 | creative commons zero | creative commons zero(?: V1)?(?: universal)?
cc-by-nc-nd | 95 | creative commons | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: V[1234])?
cc-by-nc-sa | 95 | creative commons | creative commons attribution non ?commercial share ?alike(?: V[1234])?
cc-by-nc | 93 | creative commons | creative commons attribution non ?commercial(?: V[1234])?
cc-by-nd | 93 | creative commons | creative commons attribution no ?deriv(?:ative)?s?(?: V[1234])?
cc-by-sa | 93 | creative commons | creative commons attribution share ?alike(?: V[1234])?
cc-by | 90 | creative commons | creative commons attribution(?: V[1234])?(?: international)?
cc | 70 | creative commons | creative commons licen[cs]e
cc-by-nc-nd | 85 | creativecommons org | creativecommons org licenses by nc nd(?: [1234] [05])?
cc-by-nc-sa | 85 | creativecommons org | creativecommons org licenses by nc sa(?: [1234] [05])?
cc-by-nc | 83 | creativecommons org | creativecommons org licenses by nc(?: [1234] [05])?
cc-by-nd | 83 | creativecommons org | creativecommons org licenses by nd(?: [1234] [05])?
cc-by-sa | 83 | creativecommons org | creativecommons org licenses by sa(?: [1234] [05])?
cc-by | 80 | creativecommons org | creativecommons org licenses by(?: [1234] [05])?
cc0 | 85 | creativecommons org | creativecommons org publicdomain zero(?: 1 0)?
public-domain | 60 | public domain | (?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain | 50 | public domain | (?:this (?:work|file|software|text) is )in the public domain
proprietary | 60 | all rights reserved | all rights reserved
proprietary | 65 | proprietary | proprietary and confidential
proprietary | 65 | unauthori | unauthori[sz]ed (?:copying|use|distribution|reproduction)(?: of this (?:file|work|text))?(?: via any medium)? is (?:strictly )?prohibited
proprietary | 60 | may not be reproduced | may not be reproduced(?: or (?:distributed|transmitted))?(?: in any form)?(?: by any means)? without (?:the )?(?:prior )?(?:written )?permission
"""
_VERSION = r"(?:(?:version|v|ver) ?)?"


def _rule(line: str) -> tuple[str, int, str, str]:
    label, priority, keyword, pattern = (part.strip() for part in line.split(" | "))
    return label, int(priority), keyword, pattern.replace("V", _VERSION).replace(_VERSION + "[12])", _VERSION + "[12](?: 0)?)")


#: label, priority, keyword, expression
RULES = [_rule(line) for line in _TEXT.strip().splitlines()]
